"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `window` consecutive words (a shorter item is one window). A
window is a set of word shingles. For exact containment every shingle of a window must be in the
document, so one suffices as its prefix, and the rarest does best: shingles are ordered by how
often all documents hold them, and each window is indexed under its rarest shingle with the place
of that shingle in it. Documents probe the index with every shingle. A hit's place bounds where the
window would begin; it must lie inside the document (length bound), and then the whole window is
compared.

The index holds the benchmark, not the corpus, as arrays. Its size is checked: a benchmark above
`block_bytes` of text is joined in blocks, each small enough to broadcast, and the hits are merged; each block reads the documents twice.

Defined results: null and empty texts have no words, hit nothing and, as items, have no window. A null
item_id counts as the empty string. Items with one id are one item. Repeated documents are
judged alike, each on its own. With an empty benchmark nothing is hit, and an empty table gives an empty table. A very long text takes
some 30 bytes of memory for each of its bytes. Of shingles that are equally rare the first in a window is its prefix. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames, kernels


@dataclass(frozen=True)
class Options:
    window: int = 10
    shingle: int = 5
    block_bytes: int = 8 << 20  # of benchmark text; its index takes some 15 times as much


class Sieve:
    """Membership in a set of digests; most strangers are turned away by one look at a bit table."""

    def __init__(self, digests: np.ndarray):
        self.sorted = np.unique(digests)
        self.bits = max(10, int(np.ceil(np.log2(max(2, len(self.sorted))))) + 4)
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self._slot(self.sorted)] = True

    def _slot(self, d: np.ndarray) -> np.ndarray:
        return (d >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `digests` that are members, and which members."""
        at = np.flatnonzero(self.table[self._slot(digests)])
        pos = np.searchsorted(self.sorted, digests[at])
        ok = pos < len(self.sorted)
        at, pos = at[ok], pos[ok]
        same = self.sorted[pos] == digests[at]
        return at[same], pos[same]


def _digests(words: kernels.Words, sizes: list[int]) -> dict:
    """Prefix sums of two independent word digests."""
    return {s: kernels.prefix(words.digests(s, fold_case=True)) for s in sizes}


class Windows:
    """All different windows of a block of items."""

    def __init__(self, items: list[tuple[str, str | None]], opt: Options):
        b = kernels.Batch.of([(t or "").encode() for _, t in items])
        words = kernels.Words(b, "alnum")
        self.pre = _digests(words, [31, 33])
        n = np.diff(words.first)
        length = np.minimum(n, opt.window)
        per = np.where(n > 0, n - length + 1, 0)
        item = np.repeat(np.arange(len(items)), per)
        start = np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per) + words.first[:-1][item]
        length = length[item]
        a, c = (kernels.spans(self.pre[s], start, start + length) for s in (31, 33))
        _, first, group = np.unique(a ^ kernels.mix(c), return_index=True, return_inverse=True)
        self.start, self.length, self.a, self.c = start[first], length[first], a[first], c[first]
        # the items of window g are names[i] for i in item[edges[g]:edges[g + 1]], each once
        ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(ids)}
        own = np.unique(
            np.stack((group, np.array([number[i] for i, _ in items], dtype=np.int64)[item]), axis=1), axis=0
        ) if len(item) else np.zeros((0, 2), np.int64)
        self.names, self.item, self.edges = ids, own[:, 1].astype(np.int32), np.searchsorted(own[:, 0], np.arange(len(first) + 1))
        self.k = np.minimum(self.length, opt.shingle)

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: digests, their windows and their places in them."""
        out = {}
        for k in np.unique(self.k):
            own = np.flatnonzero(self.k == k)
            per = self.length[own] - k + 1
            win = np.repeat(own, per)
            place = np.arange(len(win)) - np.repeat(np.cumsum(per) - per, per)
            at = self.start[win] + place
            out[int(k)] = kernels.spans(self.pre[31], at, at + k), win, place
        return out


def shingle_counts(docs: DataFrame, shingles: dict) -> dict[int, np.ndarray]:
    """How often all documents hold each of the benchmark's different shingles, in their order; one row for each of them at most reaches the driver."""
    sieves = {k: Sieve(v[0]) for k, v in shingles.items()}
    shipped = frames.Shipped(docs.sparkSession, sieves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = shipped.value
        acc = {k: np.zeros(len(s.sorted), dtype=np.int64) for k, s in sieves.items()}
        for rb in batches:
            for _, b in kernels.chunks(rb, "text"):
                words = kernels.Words(b, "alnum")
                pre = kernels.prefix(words.digests(31, fold_case=True))
                for k, s in sieves.items():
                    at = kernels.windows(words, k)
                    _, pos = s.find(kernels.spans(pre, at, at + k))
                    acc[k] += np.bincount(pos, minlength=len(acc[k]))
        for k, n in acc.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], names=["k", "at", "n"])

    found = docs.select("text").mapInArrow(run, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    size, at, n = (found.column(c).to_numpy() for c in ("k", "at", "n"))
    out = {}
    for k, s in sieves.items():
        out[k] = np.zeros(len(s.sorted), dtype=np.int64)
        out[k][at[size == k]] = n[size == k]
    return out


class Index:
    """Windows under their rarest shingle."""

    def __init__(self, w: Windows, shingles: dict, counts: dict[int, np.ndarray]):
        self.length, self.a, self.c, self.names, self.item, self.edges = w.length, w.a, w.c, w.names, w.item, w.edges
        self.by_size = {}
        for k, (d, win, place) in shingles.items():
            n = counts[k][np.unique(d, return_inverse=True)[1]]
            order = np.lexsort((place, d, n, win))
            first = order[np.unique(win[order], return_index=True)[1]]  # the rarest of each window
            first = first[np.argsort(d[first], kind="stable")]
            sieve = Sieve(d[first])
            begin = np.searchsorted(d[first], sieve.sorted)
            self.by_size[k] = sieve, begin, np.append(begin[1:], len(first)), win[first], place[first]

    def items(self, windows: np.ndarray) -> list[str]:
        """The sorted ids of the items that some of the windows are of."""
        own = [self.item[self.edges[w] : self.edges[w + 1]] for w in np.unique(windows).tolist()]
        return sorted(self.names[i] for i in np.unique(np.concatenate(own)).tolist())

    def probe(self, b: kernels.Batch) -> tuple[kernels.Words, np.ndarray, np.ndarray]:
        """The words of a batch, and where (first word) which windows occur."""
        words = kernels.Words(b, "alnum")
        pre = _digests(words, [31, 33])
        doc_end = np.repeat(words.first[1:], np.diff(words.first))
        doc_begin = np.repeat(words.first[:-1], np.diff(words.first))
        found_at, found = [], []
        for k, (sieve, begin, end, win, place) in self.by_size.items():
            at = kernels.windows(words, k)
            hit, pos = sieve.find(kernels.spans(pre[31], at, at + k))
            per = end[pos] - begin[pos]
            entry = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(begin[pos], per)
            seen = np.repeat(at[hit], per)
            start, w = seen - place[entry], win[entry]
            inside = (start >= doc_begin[seen]) & (start + self.length[w] <= doc_end[seen])
            start, w = start[inside], w[inside]
            same = np.ones(len(start), dtype=bool)
            for s, want in ((31, self.a), (33, self.c)):
                same &= kernels.spans(pre[s], start, start + self.length[w]) == want[w]
            found_at.append(start[same])
            found.append(w[same])
        none = np.zeros(0, dtype=np.int64)
        return words, np.concatenate(found_at or [none]), np.concatenate(found or [none])


def _blocks(benchmark: DataFrame, opt: Options) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    n = -(-size // opt.block_bytes) or 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


OUT = "doc_id long, text_key long, n_words long, hit_starts array<long>, hit_ends array<long>, items array<string>"


def _index(docs: DataFrame, block: DataFrame, opt: Options) -> Index:
    w = Windows([(r["item_id"], r["text"]) for r in block.collect()], opt)
    shingles = w.shingles()
    return Index(w, shingles, shingle_counts(docs, shingles))


def _probe_block(docs: DataFrame, index: Index) -> DataFrame:
    shipped = frames.Shipped(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for rb in batches:
            for part, b in kernels.chunks(rb, "text"):
                words, at, w = index.probe(b)
                n_words = np.diff(words.first)
                mask = kernels.cover(len(words.start), at, index.length[w])
                starts, ends, items = ([[] for _ in range(b.n)] for _ in range(3))
                doc = np.searchsorted(words.first, at, side="right") - 1
                for i in np.unique(doc).tolist():
                    a, e = kernels.runs(mask[words.first[i] : words.first[i + 1]])
                    starts[i], ends[i] = a.tolist(), e.tolist()
                    items[i] = index.items(w[doc == i])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array(n_words), pa.array(starts, pa.list_(pa.int64())),
                        pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))
                    ],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    return docs.select("doc_id", "text", frames.text_key().alias("text_key")).mapInArrow(run, OUT)


def hits(docs: DataFrame, benchmark: DataFrame, opt: Options = Options()) -> DataFrame:
    """Per document: the runs of hit words [hit_starts, hit_ends) and the sorted ids of the items with occurring windows."""
    docs = docs.select("doc_id", "text")
    blocks = _blocks(benchmark, opt)
    if len(blocks) == 1:
        return _probe_block(docs, _index(docs, blocks[0], opt))
    key = ["doc_id", "text_key"]
    found = None
    for block in blocks:
        one = frames.Saved(_probe_block(docs, _index(docs, block, opt)).where(F.size("items") > 0).dropDuplicates(key)).df
        found = one if found is None else found.unionByName(one)
    found = found.withColumn("doc_id", frames.null_first_id("doc_id"))
    spans = found.select(*key, "items", F.arrays_zip("hit_starts", "hit_ends").alias("s")).groupBy(*key).agg(
        F.flatten(F.collect_list("s")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    merged = F.aggregate(
        F.array_sort("s"),
        F.expr("cast(array() as array<struct<a:bigint,e:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["hit_starts"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["e"], x["hit_ends"]).alias("e")))
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["hit_starts"].alias("a"), x["hit_ends"].alias("e"))))),
    )
    spans = spans.select(*key, "items", merged.alias("m"))
    everyone = _probe_block(docs, Index(w := Windows([], opt), w.shingles(), {})).select(
        "doc_id", F.struct(frames.null_first_id("doc_id").alias("i"), "text_key").alias("k"), "text_key", "n_words"
    )
    spans = spans.select(F.struct(F.col("doc_id").alias("i"), "text_key").alias("k"), "items", "m")
    none_l, none_s = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<string>)")
    return everyone.join(spans, "k", "left").select(
        "doc_id", "text_key", "n_words",
        F.coalesce(F.transform("m", lambda x: x["a"]), none_l).alias("hit_starts"),
        F.coalesce(F.transform("m", lambda x: x["e"]), none_l).alias("hit_ends"), F.coalesce("items", none_s).alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, opt: Options = Options(), columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The documents that hold no window of any item, with all of the given columns."""
    blocks = _blocks(benchmark, opt)
    at = columns.index("text")
    for block in blocks:
        shipped = frames.Shipped(docs.sparkSession, _index(docs, block, opt))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for rb in batches:
                for part, b in kernels.chunks(rb, rb.schema.names[at]):
                    words, start, _ = index.probe(b)
                    keep = np.ones(b.n, dtype=bool)
                    keep[np.searchsorted(words.first, start, side="right") - 1] = False
                    yield part.filter(pa.array(keep))

        docs = docs.select(*columns)
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = frames.pick(frames.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    bench = frames.pick(frames.table(spark, sf_dir, "benchmark"), item_id="string", text="string")
    return digest(hits(docs, bench))
