"""Exact substring dedup of word windows with fixed-block anchors.

1. Anchors. Every document is an index of its non-overlapping blocks of `window // 2` words, and a
   probe with every rolling window of that size. Any `window` consecutive words hold a whole
   block, so two documents share a window only if a rolling probe of one hits a block of the other. Digests
   meet in buckets (see routing); a hit is a digest that is a block somewhere and is found in two documents or more.
2. Extension. Around each hit the windows that contain it are compared over all documents by 128-bit
   digests; each digest's smallest doc_id wins, and later documents lose the words of theirs. Adjacent lost
   windows make up the maximal exact repeats. Windows are judged on the input.

A digest's occurrences are never paired with each other: a bucket keeps one smallest id for each digest.

Defined results: a null or empty text has no words and loses none. Documents of one doc_id (repeated rows) are
one document to each other: none is earlier. A null doc_id is earlier than none and later than all.
A very long text is one batch, with some 40 bytes of memory for each of its bytes. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames, kernels, routing
from tidemark.llm.decontamination import Sieve

NO_ID = -(2**63)


@dataclass(frozen=True)
class Options:
    window: int = 50

    @property
    def block(self) -> int:
        return (self.window + 1) // 2


def _ids(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


class _Batches:
    """Numbers a task's batches; a batch's header has its documents' keys and their first words."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 32

    def number(self) -> int:
        self.next += 1
        return self.next


def _own(number: int, n: int, part: pa.RecordBatch, words: kernels.Words, at: np.ndarray) -> list[tuple]:
    """What a batch sends to itself: its documents' keys and first words, and the places that it has answered already."""
    bucket = -1 - number % n
    head = routing.join(
        b"H", struct.pack("<q", number), _ids(part.column(0)).tobytes(), _ids(part.column(1)).tobytes(),
        words.first.astype(np.int64).tobytes()
    )
    return [(bucket, number, head), (bucket, number, routing.local(number, at))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return routing.table_of(rows, routing.SENT).combine_chunks().to_batches()[0]


ANCHORS = "dz", [np.uint32, np.uint8]
WINDOWS = "ddz", [np.uint32, np.uint64, np.int64]


def _send_anchors(opt: Options, n_buckets: int):
    size = opt.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Batches()
        for rb in kernels.gathered(batches, routing.BATCH_BYTES):
            for part, b in kernels.chunks(rb, "text", routing.BATCH_BYTES):
                words = kernels.Words(b)
                at = kernels.windows(words, size)
                if not len(at):
                    continue
                d = kernels.spans(kernels.prefix(words.digests(41)), at, at + size)
                doc = words.doc[at]
                block = (at - words.first[doc]) % size == 0
                # digests that several documents of this batch hold are hits at once, and are sent once
                twice, _ = Sieve(routing.repeated(d)).find(d)
                order = twice[np.lexsort((doc[twice], d[twice]))]
                new = np.diff(d[order], prepend=~d[order[:1]]) != 0
                group = np.cumsum(new) - 1
                shared = np.zeros(new.sum(), dtype=bool)
                shared[group[1:][(group[1:] == group[:-1]) & (doc[order][1:] != doc[order][:-1])]] = True
                some_block = np.zeros(len(shared), dtype=bool)
                np.logical_or.at(some_block, group, block[order])
                here = np.zeros(len(at), dtype=bool)
                here[order] = shared[group]
                first = order[new][shared]
                block[first] = some_block[shared]
                send = ~here
                send[first] = True
                send = np.flatnonzero(send)
                number = numbers.number()
                flags = block[send].astype(np.uint8) + 2 * here[send].astype(np.uint8)
                rows = routing.outgoing(
                    number, routing.bucket_of(d[send], n_buckets), at[send], [d[send].astype(np.uint32), flags], ANCHORS[0], n_buckets
                )
                yield _batch(_own(number, n_buckets, part, words, at[here]) + rows)

    return run


def _to_regions(table: pa.Table, n_buckets: int) -> pa.Table:
    """Rows that batches sent to themselves go on to their regions."""
    return pa.table({"batch": pa.array(table.column("batch").to_numpy() >> routing.shift(n_buckets)), "payload": table.column("payload")})


def _meet_anchors(n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kernels.trim()
        if key[0].as_py() < 0:
            return _to_regions(table, n_buckets)
        number, at, (value, flag) = routing.entries(table, *ANCHORS)
        batch = np.unique(number, return_inverse=True)[1].astype(np.uint64)
        order = np.argsort(value.astype(np.uint64) << np.uint64(32) | batch)
        batch = batch[order]
        new = np.diff(value[order].astype(np.int64), prepend=-1) != 0
        group = np.cumsum(new) - 1
        several = np.zeros(int(new.sum()), dtype=bool)
        several[group[1:][(group[1:] == group[:-1]) & (batch[1:] != batch[:-1])]] = True
        several[group[flag[order] >= 2]] = True
        blocks = np.zeros(len(several), dtype=bool)
        blocks[group[flag[order] % 2 == 1]] = True
        hit = np.zeros(len(value), dtype=bool)
        hit[order] = (several & blocks)[group]
        hit &= flag < 2
        return routing.replies(number[hit], at[hit], n_buckets)

    return run


RUNS = "id long, text_key long, starts array<int>, ends array<int>"


def _answer(before: int):
    """Per document, the runs of window starts that an answered place lies in: from `before` words ahead of it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        headers, found = routing.answers(table.column("payload").to_pylist())
        out = []
        for number, flat in found.items():
            ids, keys, first = (np.frombuffer(x, np.int64) for x in headers[number])
            doc = np.searchsorted(first, flat, side="right") - 1
            low = np.maximum(flat - before, first[doc])
            mask = kernels.cover(int(first[-1]), low, flat + 1 - low)
            for i in np.unique(doc).tolist():
                a, e = kernels.runs(mask[first[i] : first[i + 1]])
                out.append((int(ids[i]), int(keys[i]), a.tolist(), e.tolist()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "text_key", "starts", "ends"])

    return run


def _marked(words: kernels.Words, part: pa.RecordBatch, starts: str, ends: str, extra: int = 0) -> np.ndarray:
    """True for the words (flat) inside the documents' runs, each run made longer by `extra`."""
    a, e = (part.column(part.schema.get_field_index(c)) for c in (starts, ends))
    n = np.array([0 if x is None else x for x in pa.compute.list_value_length(a).to_pylist()], dtype=np.int64)
    base = np.repeat(words.first[:-1], n)
    d = np.zeros(len(words.start) + 1, dtype=np.int32)
    np.add.at(d, base + a.flatten().to_numpy(zero_copy_only=False), 1)
    np.add.at(d, np.minimum(base + e.flatten().to_numpy(zero_copy_only=False) + extra, np.repeat(words.first[1:], n)), -1)
    return np.cumsum(d[:-1]) > 0


def _send_windows(opt: Options, n_buckets: int):
    size = opt.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        numbers = _Batches()
        for rb in kernels.gathered(batches, routing.BATCH_BYTES):
            for part, b in kernels.chunks(rb, "text", routing.BATCH_BYTES):
                words = kernels.Words(b)
                at = kernels.windows(words, size)
                at = at[_marked(words, part, "starts", "ends")[at]]
                if not len(at):
                    continue
                x, y = (kernels.spans(kernels.prefix(words.digests(s)), at, at + size) for s in (43, 45))
                ids = _ids(part.column(0))
                rank = np.where(ids == NO_ID, 2**63 - 1, ids)[words.doc[at]]
                # of a digest in several of this batch's documents, only the smallest document's is sent
                twice, _ = Sieve(routing.repeated(x)).find(x)
                order = twice[np.lexsort((rank[twice], y[twice], x[twice]))]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
                least = rank[order][new][np.cumsum(new) - 1] if len(order) else rank[:0]
                gone = np.zeros(len(at), dtype=bool)
                gone[order] = rank[order] > least
                send = np.flatnonzero(~gone)
                number = numbers.number()
                rows = routing.outgoing(
                    number, routing.bucket_of(x[send], n_buckets), at[send], [x[send].astype(np.uint32), y[send], rank[send]], WINDOWS[0],
                    n_buckets
                )
                yield _batch(_own(number, n_buckets, part, words, at[gone]) + rows)

    return run


def _meet_windows(n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kernels.trim()
        if key[0].as_py() < 0:
            return _to_regions(table, n_buckets)
        number, at, (x, y, rank) = routing.entries(table, *WINDOWS)
        order = np.lexsort((rank, x, y))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
        least = rank[order][new][np.cumsum(new) - 1]
        later = np.zeros(len(order), dtype=bool)
        later[order] = rank[order] > least
        return routing.replies(number[later], at[later], n_buckets)

    return run


def _round(docs: DataFrame, send, meet, kind: tuple, n_buckets: int, before: int) -> frames.Saved:
    sent = docs.mapInArrow(send, routing.SENT)
    if routing.shift(n_buckets):
        region = F.shiftright("batch", routing.shift(n_buckets)).alias("region")
        sent = sent.select("bucket", region, "batch", "payload").groupBy("bucket", "region").applyInArrow(
            routing.spread(*kind, n_buckets), routing.SENT
        )
    met = sent.groupBy("bucket").applyInArrow(meet(n_buckets), routing.REPLY)
    return frames.Saved(met.groupBy("batch").applyInArrow(_answer(before), RUNS).dropDuplicates(["id", "text_key"]))


def repeats(docs: DataFrame, opt: Options = Options()) -> frames.Saved:
    """Saved table (id, text_key, starts, ends): runs of window starts that a smaller doc_id also has."""
    docs = docs.select(
        frames.null_first_id("doc_id").alias("id"), frames.text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = routing.buckets_for(size)
    anchors = _round(docs, _send_anchors(opt, n), _meet_anchors, ANCHORS, n, opt.window - opt.block)
    near = docs.join(anchors.df.hint("merge"), ["id", "text_key"])
    marked = anchors.df.agg(
        F.sum(F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")
    ).first()["n"] or 0
    n = routing.buckets_for(8 * marked)
    out = _round(near, _send_windows(opt, n), _meet_windows, WINDOWS, n, 0)
    anchors.drop()
    return out


def strip(docs: DataFrame, opt: Options = Options(), columns: tuple[str, ...] = ("doc_id", "text"), normalise: bool = True) -> DataFrame:
    """The given columns with the text that is left, and n_words, removed_starts, removed_ends (runs of words).

    Kept words are joined by one space; without normalise, a text that loses nothing stays as it is.
    """
    found = repeats(docs, opt).df.withColumnsRenamed({"id": "_id", "text_key": "_key"})
    left = docs.select(*columns, frames.null_first_id("doc_id").alias("_id"), frames.text_key().alias("_key"))
    joined = left.join(found.hint("merge"), ["_id", "_key"], "left").select(*columns, "starts", "ends")
    schema = ", ".join(
        f"{c} {t}" for c, t in joined.select(*columns).dtypes
    ) + ", n_words long, removed_starts array<int>, removed_ends array<int>"
    at_text, window = columns.index("text"), opt.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for rb in batches:
            for part, b in kernels.chunks(rb, "text"):
                words = kernels.Words(b)
                gone = _marked(words, part, "starts", "ends", window - 1)
                lost = np.concatenate(([0], np.cumsum(gone)))
                lost = lost[words.first[1:]] > lost[words.first[:-1]]
                starts, ends = [[] for _ in range(b.n)], [[] for _ in range(b.n)]
                texts = part.column(at_text).to_pylist() if not normalise else [None] * b.n
                for i in range(b.n):
                    if not lost[i]:
                        if normalise:
                            texts[i] = b" ".join(b.text(i).split())
                        continue
                    lo, hi = words.first[i], words.first[i + 1]
                    a, e = kernels.runs(gone[lo:hi])
                    starts[i], ends[i] = a.tolist(), e.tolist()
                    a, e = kernels.runs(~gone[lo:hi])
                    kept = [
                        b.buf[words.start[lo + p] : words.end[lo + q - 1]].tobytes() for p, q in zip(a.tolist(), e.tolist(), strict=True)
                    ]
                    texts[i] = b" ".join(b" ".join(kept).split())
                text = pa.array([t.decode() if isinstance(t, bytes) else t for t in texts], pa.string())
                cols = [text if k == at_text else part.column(k) for k in range(len(columns))]
                cols += [pa.array(np.diff(words.first)), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*columns, "n_words", "removed_starts", "removed_ends"])

    return joined.mapInArrow(run, schema)


def digest(stripped: DataFrame) -> DataFrame:
    n = F.aggregate(F.zip_with("removed_ends", "removed_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return stripped.select("doc_id", "n_words", n.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(strip(frames.pick(frames.table(spark, sf_dir, "documents"), doc_id="long", text="string")))
