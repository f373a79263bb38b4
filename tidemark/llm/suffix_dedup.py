"""Exact substring dedup over bytes with suffix arrays.

A string of `length` bytes goes if it also starts anywhere else.

1. Cells. Every string is filed under the least digest among its `gram`-byte substrings. Equal strings
   have the same least digest, so strings of different cells are never compared. Strings that follow each other in a
   document and have one cell make up a context, so each place of a document is in one context. Contexts that are alike as a whole
   (a 128-bit digest) are collapsed into one; a context that was found twice is all repeats, one
   that is alone in its cell and not periodic has none, and only the other cells go on.
2. Suffix arrays. Cells are dealt into buckets and a bucket into shards of bounded size, which are sorted one after the other by
   Larsson-Sadakane refinement. Kasai's common prefixes decide: a place is lost if its suffix shares `length` bytes or more
   with the one before or after it. A cell with more text than a shard is spread over several; its strings that are not lost yet are
   looked up in the other shards' suffix arrays by binary search.
3. A cell of very many different contexts is not given to one task. The strings of its contexts are filed anew by longer
   grams, at last by their own digest, which leaves one context for each cell.

Matches never cross documents, and strings are judged on the input.

Defined results: a null or empty text has no bytes. Repeated rows are separate documents, so texts of
`length` bytes or more lose everything in each. A null doc_id is a document like others. A very long text is worked
through in overlapping pieces. Strings have no order, so there are no ties. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames, kernels, suffix_array

BUCKET_BYTES = 4 << 20


@dataclass(frozen=True)
class Options:
    length: int = 400
    gram: int = 64
    cell: int = 4096  # different contexts of a cell, at most, that one task sorts

    def grams(self) -> list[int]:
        """The gram lengths of step 1 and of each refinement of step 3."""
        out = [self.gram]
        while out[-1] < self.length:
            out.append(min(self.length, out[-1] + max(1, (self.length - out[-1]) * 2 // 3), out[-1] * 3))
        return out


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each x[i:i + w] (block prefixes and suffixes); the last w - 1 places reach past the end."""
    n = len(x)
    b = np.concatenate((x, np.full((-n) % w + w, 2**64 - 1, dtype=np.uint64))).reshape(-1, w)
    pre = np.minimum.accumulate(b, axis=1).ravel()
    suf = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[:n], pre[w - 1 : n + w - 1])


def contexts(b: kernels.Batch, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs [first, last] of starts of strings inside one document with one least gram, that gram's digest, and whether a run may repeat itself.

    A string of a run can equal a later one of it only if its gram begins before the last start.

    A run has at most as many starts as strings can share one gram, so that
    periodic text gives runs of bounded length, too.
    """
    n, w = len(b.buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    inside = kernels.cover(n, b.off[:-1], np.maximum(0, b.off[1:] - b.off[:-1] - length + 1))
    d = kernels.rolling(kernels.prefix(b.buf, kernels.byte_table(61)), gram)
    least = _slide(d, w)
    least = np.concatenate((least, np.zeros(n - len(least), np.uint64)))
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    new[b.off[:-1][b.off[:-1] < n]] = True
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    some = inside[at]
    at, size = at[some], size[some]
    per = -(-size // w)
    part = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(at, per) + part * w
    stop = np.minimum(start + w, np.repeat(at + size, per)) - 1
    own = np.concatenate(([0], np.cumsum(d == least[: len(d)], dtype=np.int32)))
    return start, stop, least[start], own[np.minimum(stop, len(d))] > own[np.minimum(start, len(d))]


CONTEXTS = "cell long, x long, y long, doc_id long, text_key long, first int, last int, within boolean, weight long"


def _context_rows(texts: DataFrame, opt: Options, gram: int) -> DataFrame:
    """The contexts of all texts (doc_id, text_key, text). Where texts are contexts themselves (with base, weight), theirs with their own text."""
    inner = "base" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, keys = (rb.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            origin, weight = (rb.column(k).to_numpy().astype(np.int64) for k in (3, 4)) if inner else (
                np.zeros(rb.num_rows, np.int64), np.ones(rb.num_rows, np.int64)
            )
            for rows, base, b in kernels.pieces(rb, "text", opt.length - 1):
                first, last, cell, within = contexts(b, opt.length, gram)
                x, y = (kernels.spans(kernels.prefix(b.buf, kernels.byte_table(s)), first, last + opt.length) for s in (63, 67))
                doc = np.searchsorted(b.off, first, side="right") - 1
                row = rows[doc]
                shift = base[doc] + origin[row] - b.off[doc]
                cols = [
                    *(v.view(np.int64) for v in (cell, x, y)), ids[row], keys[row], *((v + shift).astype(np.int32) for v in (first, last)),
                    within, weight[row]
                ]
                out = [pa.array(v) for v in cols]
                if inner:
                    out.append(_slices(b.buf, first, last + opt.length))
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in CONTEXTS.split(", ")] + ["text"] * inner)

    return texts.mapInArrow(run, CONTEXTS + ", text binary" * inner)


def _slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Spans of a buffer as a binary column."""
    n = end - start
    off = np.concatenate(([0], np.cumsum(n)))
    place = np.repeat(start - off[:-1], n) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(buf[place])])


class _Ranges:
    """A column of lists of (first, last)."""

    def __init__(self, col: pa.Array):
        flat = col.flatten()
        self.first, self.last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        self.off = np.concatenate(([0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))

    def rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ranges of some rows, and which of them each belongs to."""
        per = self.off[rows + 1] - self.off[rows]
        of = np.repeat(np.arange(len(rows)), per)
        k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per) + self.off[rows][of]
        return self.first[k], self.last[k], of


def _by_doc(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("at"))


SPANS = "doc_id long, text_key long, first int, last int"
CUT = "cell long, alone boolean, size long, doc_id long, text_key long, first int, text binary"


class _Shard:
    """One sorted shard of a bucket: its text, which places start a string, and which of these are lost."""

    def __init__(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int):
        self.text, self.begin = text, begin
        sa = suffix_array.suffixes(text, 2 * length)
        common = suffix_array.kasai(text, sa, length)
        hit = np.flatnonzero(common[sa] >= length)
        self.gone = np.zeros(len(text), dtype=bool)
        self.gone[sa[hit]] = True
        self.gone[sa[hit - 1]] = True
        self.gone &= kernels.cover(
            len(text), begin, end - begin - length + 1
        )  # suffixes that start no whole string may agree beyond their text's end
        self.sa, self.end, self.length = sa, end, length

    def strings(self, some: np.ndarray) -> np.ndarray:
        """Places of whole strings of the given texts, in the order of their suffixes."""
        row = np.searchsorted(self.begin, self.sa, side="right") - 1
        return self.sa[some[row] & (self.sa + self.length <= self.end[row])]


def _sort_bucket(opt: Options):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("cell")
        cell, alone = t.column("cell").to_numpy(), t.column("alone").to_numpy(zero_copy_only=False)
        b = kernels.arrow_batch(t.column("text"))
        used = np.zeros(256, dtype=bool)
        used[b.buf] = True
        code = np.cumsum(used).astype(np.uint8)  # at most 243 byte values are in UTF-8
        size = np.diff(b.off) + 1
        shards: list[tuple[int, int]] = []
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(size[lo:]), suffix_array.MAX_BYTES, side="right")))
            shards.append((lo, hi))
            lo = hi
        split = {int(cell[hi]) for _, hi in shards[:-1] if cell[hi] == cell[hi - 1]}
        out: list[tuple] = []
        kept = []
        for lo, hi in shards:
            end = np.cumsum(size[lo:hi]) - 1
            begin = end + 1 - size[lo:hi]
            text = np.zeros(int(end[-1]) + 1, dtype=np.uint8)
            body = np.ones(len(text), dtype=bool)
            body[end] = False
            text[body] = code[b.buf[b.off[lo] : b.off[hi]]]
            s = _Shard(text, begin, end, opt.length)
            some = np.isin(cell[lo:hi], list(split)) if split else np.zeros(hi - lo, dtype=bool)
            if some.any():
                kept.append((lo, s, s.strings(some)))
                s.sa = None
            else:
                out.append(_lost(lo, s, t, alone))
        for lo, s, at in kept:
            for _, other, there in kept:
                if other is not s:
                    todo = at[~s.gone[at]]
                    s.gone[todo[suffix_array.find(s.text, todo, other.text, there, opt.length)]] = True
            out.append(_lost(lo, s, t, alone))
        return pa.concat_tables(out)

    return run


def _lost(lo: int, s: _Shard, t: pa.Table, alone: np.ndarray) -> pa.Table:
    """The runs of lost starts of the shard's contexts; those that were found twice as a whole are known already."""
    a, e = kernels.runs(s.gone)
    row = np.searchsorted(s.begin, a, side="right") - 1
    some = alone[lo + row]
    a, e, row = a[some], e[some], row[some]
    at = pa.array(lo + row)
    first = t.column("first").to_numpy()[lo + row] - s.begin[row]
    return pa.table(
        {
            "doc_id": t.column("doc_id").take(at), "text_key": t.column("text_key").take(at),
            "first": pa.array((first + a).astype(np.int32)), "last": pa.array((first + e - 1).astype(np.int32))
        }
    )


def _cut_texts(docs: DataFrame, rows: DataFrame, opt: Options) -> DataFrame:
    """The texts of the given contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, keys = (rb.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            whole = kernels.arrow_batch(rb.column(2))
            at = _Ranges(rb.column(3))
            flat = rb.column(3).flatten()
            first, last, of = at.rows(np.arange(rb.num_rows))
            lo, size = whole.off[of] + first, last - first + opt.length
            total = np.cumsum(size)
            begin = 0
            while begin < len(of):
                to = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + kernels.CHUNK_BYTES, side="right")))
                own = of[begin:to]
                text = _slices(whole.buf, lo[begin:to], lo[begin:to] + size[begin:to])
                cols = [
                    *(flat.field(k).slice(begin, to - begin) for k in (2, 3, 4)), pa.array(ids[own]), pa.array(keys[own]),
                    pa.array(first[begin:to].astype(np.int32)), text
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CUT.split(", ")])
                begin = to

    lists = rows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last", "cell", "alone", "size")).alias("at"))
    one = docs.dropDuplicates(["doc_id", "text_key"])
    return frames.join(one, lists, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "at").mapInArrow(run, CUT)


def repeats(docs: DataFrame, opt: Options = Options()) -> frames.Saved:
    """Saved table (doc_id, text_key, at): ranges [first, last] of starts of strings that also start elsewhere. doc_id null is the least long."""
    docs = docs.select(
        frames.null_first_id("doc_id").alias("doc_id"), frames.text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")
    )
    with frames.Scratch() as keep:
        return frames.Saved(_by_doc(_found(docs.where(F.octet_length("text") >= opt.length), opt, keep)))


def _found(long: DataFrame, opt: Options, keep: frames.Scratch) -> DataFrame:
    found, at = [], ["doc_id", "text_key", "first"]
    rows, level = keep(_context_rows(long.select("doc_id", "text_key", "text"), opt, opt.gram)), 0
    while True:
        firsts = (F.first(c).alias(c) for c in (*at, "last", "within"))  # all from one row
        known = keep(rows.groupBy("cell", "x", "y").agg((F.sum("weight") == 1).alias("alone"), *firsts))
        cells = known.groupBy("cell").agg(F.count("*").alias("size"), F.max("alone").alias("some"), F.max("within").alias("within"))
        found.append(
            keep(
                frames.join(
                    rows.where("weight = 1"), known.where("not alone").select("cell", "x", "y"), ["cell", "x", "y"], "left_semi"
                ).select(*at, "last")
            )
        )
        mixed = cells.where("some and (size > 1 or within)").select("cell", "size")
        todo = keep(frames.join(known, mixed, ["cell"]).select("cell", *at, "last", "alone", "size"))
        if level == 0:
            texts = keep(_cut_texts(long, todo, opt))
        else:
            texts = keep(frames.join(rows.select(*at, "text"), todo, at).select("cell", "alone", "size", *at, "text"))
        small = texts.where(F.col("size") <= opt.cell)
        total = small.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        if total:
            buckets = small.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(-(-total // BUCKET_BYTES))))
            found.append(keep(buckets.groupBy("bucket").applyInArrow(_sort_bucket(opt), SPANS)))
        large = texts.where(F.col("size") > opt.cell)
        if not large.limit(1).count():
            break
        level += 1
        weight = F.when(F.col("alone"), 1).otherwise(2).cast("long")
        rows = keep(
            _context_rows(
                large.select("doc_id", "text_key", "text", F.col("first").alias("base"), weight.alias("weight")), opt, opt.grams()[level]
            )
        )
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every


OUT = "n_bytes long, removed_starts array<long>, removed_ends array<long>, kept binary"


def strip(docs: DataFrame, opt: Options = Options()) -> DataFrame:
    """doc_id, n_bytes, the removed runs [removed_starts, removed_ends) and the bytes that are left."""
    at = repeats(docs, opt).df.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    left = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), frames.null_first_id("doc_id").alias("_id"), frames.text_key().alias("_key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part, b in kernels.chunks(rb, "text"):
                first, last, of = _Ranges(part.column(2)).rows(np.arange(b.n))
                gone = kernels.cover(len(b.buf), b.off[of] + first, last - first + opt.length)
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                a, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                # a run that goes on into the next document is one run in each
                cut = b.off[1:-1][(b.off[1:-1] > 0) & (b.off[1:-1] < len(gone))]
                cut = np.unique(cut[gone[cut] & gone[cut - 1]]) if len(cut) else cut
                a, e = np.sort(np.concatenate((a, cut))), np.sort(np.concatenate((e, cut)))
                doc = np.searchsorted(b.off, a, side="right") - 1
                lists = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b.n)))).astype(np.int32)
                left = b.buf[~gone]
                off = np.concatenate(([0], np.cumsum(~gone)))[b.off] if len(gone) else b.off
                kept = pa.Array.from_buffers(
                    pa.binary(), b.n, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(left))]
                )
                starts, ends = (pa.ListArray.from_arrays(pa.array(lists), pa.array(v - b.off[doc])) for v in (a, e))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(b.off)), starts, ends, kept],
                    names=["doc_id", "n_bytes", "removed_starts", "removed_ends", "kept"]
                )

    return frames.join(left, at, ["_id", "_key"], "left").select("doc_id", "text", "at").mapInArrow(run, f"doc_id long, {OUT}")


def query(spark, sf_dir: str) -> DataFrame:
    out = strip(frames.pick(frames.table(spark, sf_dir, "documents"), doc_id="long", text="string"))
    n = F.aggregate(F.zip_with("removed_ends", "removed_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "doc_id", "n_bytes", n.alias("n_removed"), F.size("removed_starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256")
    )
