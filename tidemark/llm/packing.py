"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' ids. In each window every queue is owed its share of the
window's tokens; what it has been given less or more than owed is its deficit and goes on to the
next window. The deficit counters have a closed form. Give id i of a queue with rate r the pass
value (2 i + 1) / (2 r), scaled to integers: serving ids in the order of (pass, queue) keeps every
queue within one token of what it is owed at any time. So what a queue has given in the first w
windows, `served(w)`, is computed for any w by itself, and each partition cuts its documents
without waiting for the windows before: deficits carry across windows and partitions alike. A
queue that runs dry leaves its slots to the others in proportion. Inside a window each queue's
ids are contiguous. All windows are full but the last.

Target shares are by default those of the corpus, or the given weights. Where there are more
sources than `max_queues`, those without a weight of their own are dealt over `max_queues` groups.
The groups, and the sources with weights, are then the queues above, and inside a group a binary
tree shares each node's ids between its halves in proportion to their tokens. As sources without
weights run dry together, the target shares are those of a queue for each source; the tree holds
them to one token and a half more for each level. A document knows only its source's path in the tree, so a task
holds a bounded state, however many sources there are.

Defined results: a null or empty text is its end id alone; a null source is a queue of its own.
Repeated rows are packed each. An empty table packs to nothing. Ids with equal pass values go in the order of their queues' names. A very long
text is encoded as a whole and cut into as many pieces as it needs. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import encoder, frames, kernels


@dataclass(frozen=True)
class Options:
    end_id: int
    length: int = 1024
    max_queues: int = 1024
    weights: tuple[tuple[str, float], ...] = ()  # target shares by source; others share what the corpus gives them


class Schedule:
    """Deficit round-robin over queues of the given lengths and rates, in closed form."""

    def __init__(self, lengths: list[int], rates: list[float], length: int):
        self.n = np.array(lengths, dtype=np.int64)
        self.length, self.total = length, int(self.n.sum())
        share = np.array(rates, dtype=np.float64)
        share = np.maximum(share / share.sum(), 1e-9) if len(share) else share
        longest = max([1.0, *(2.0 * self.n / share)]) if len(share) else 1.0
        scale = 2.0 ** max(8, 60 - int(np.ceil(np.log2(longest))))
        self.half = np.maximum(1, np.floor(scale / share)).astype(np.int64) if len(share) else self.n

    def _count(self, t: np.ndarray) -> np.ndarray:
        """Ids of each queue with a pass of at most t."""
        return np.minimum(self.n, (t[:, None] + self.half) // (2 * self.half))

    def served(self, w: np.ndarray) -> np.ndarray:
        """Ids of each queue (columns) in the first w windows (rows)."""
        need = np.minimum(np.asarray(w, dtype=np.int64) * self.length, self.total)
        low, high = np.full(len(need), -1, dtype=np.int64), np.full(len(need), int((2 * self.n * self.half).max(initial=1)), dtype=np.int64)
        while (gap := high - low > 1).any():  # low: too few; high: enough
            mid = low + (high - low) // 2
            enough = self._count(mid).sum(1) >= need
            high, low = np.where(gap & enough, mid, high), np.where(gap & ~enough, mid, low)
        below = np.where((low >= 0)[:, None], self._count(np.maximum(low, 0)), 0)
        tied = self._count(high) - below  # at equal pass, queues go in their order
        order = np.cumsum(tied, axis=1)
        return below + np.where(order <= (need - below.sum(1))[:, None], tied, 0)

    def window(self, queue: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The window of id i of a queue."""
        own = (2 * i + 1) * self.half[queue]
        before, at = self._count(own - 1), self._count(own)
        earlier = np.arange(len(self.n))[None, :] < queue[:, None]
        return (before.sum(1) + ((at - before) * earlier).sum(1)) // self.length


class Tree:
    """Where the ids of sources lie in the order of their groups.

    For each row a path from the root of its group's tree to its source: at each level the ids of the node, the ids
    of its left half, and whether the source lies there. Of the first x ids of a node, round(x * left / node) go left.
    """

    def __init__(self, node: np.ndarray, left: np.ndarray, is_left: np.ndarray):
        kind = np.int64 if node.max(initial=0) < 1 << 30 else object  # products of three fit, or Python's integers
        self.node, self.left, self.is_left, self.kind = node.astype(kind), left.astype(kind), is_left, kind

    @classmethod
    def of(cls, rb: pa.RecordBatch) -> Tree:
        node, left, is_left = (rb.column(c).to_pylist() for c in ("node", "left", "is_left"))
        deep = max(map(len, node), default=0)
        pad = lambda rows, fill: np.array(
            [x + [fill] * (deep - len(x)) for x in rows]
        ).reshape(len(rows), deep)  # noqa: E731  a node that is all left passes ids on as they are
        return cls(pad(node, 1).astype(np.int64), pad(left, 1).astype(np.int64), pad(is_left, True).astype(bool))

    @staticmethod
    def paths(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """node, left and is_left of each of the sources of a group, which have n ids each."""
        k, low, high = np.arange(len(n)), np.zeros(len(n), dtype=np.int64), np.full(len(n), len(n))
        ends, out = np.concatenate(([0], np.cumsum(n))), []
        while (high - low > 1).any():
            mid = np.where(high - low > 1, (low + high) // 2, high)
            out.append((ends[high] - ends[low], ends[mid] - ends[low], k < mid))
            low, high = np.where(k < mid, low, mid), np.where(k < mid, mid, high)
        return tuple(np.array([x[i] for x in out]).reshape(len(out), len(n)).T for i in range(3))

    def served(self, x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the first x ids of the row's group: those of its source, and those of the sources before it."""
        x, before = x.astype(self.kind), np.zeros(len(x), dtype=self.kind)
        for node, left, is_left in zip(self.node[row].T, self.left[row].T, self.is_left[row].T, strict=True):
            first = (2 * x * left + node) // (2 * node)
            before, x = before + np.where(is_left, 0, first), np.where(is_left, first, x - first)
        return x.astype(np.int64), before.astype(np.int64)

    def place(self, i: np.ndarray) -> np.ndarray:
        """The place in its group's order of id i of each row's source."""
        i = i.astype(self.kind)
        for node, left, is_left in zip(self.node.T[::-1], self.left.T[::-1], self.is_left.T[::-1], strict=True):
            right = np.where(is_left, 1, node - left)
            i = np.where(is_left, -(-node * (2 * i + 1) // (2 * left)) - 1, node * (2 * i + 1) // (2 * right))
        return i.astype(np.int64)


def tokenise(docs: DataFrame, tokenizer_path: str, opt: Options) -> frames.Saved:
    """(part, doc_id, queue, local_start, n_tokens, ids): local_start counts the ids of that queue before it in its part."""
    spark = docs.sparkSession
    spec = encoder.read_spec(tokenizer_path)
    width = 2 if max(encoder.vocab_size(spec), opt.end_id + 1) <= 1 << 16 else 4
    shipped, end_id = frames.Shipped(spark, spec), opt.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder.encoder(shipped.value), TaskContext.get().partitionId()
        at = {}
        for rb in batches:
            for begin in range(0, rb.num_rows, 512):
                piece = rb.slice(begin, 512)
                flat, sizes = enc.encode_batch(kernels.arrow_batch(piece.column(2)))
                flat = np.insert(flat.astype(f"<u{width}"), np.cumsum(sizes), end_id)
                sizes += 1
                off = np.concatenate(([0], np.cumsum(sizes)))
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((off * width).astype(np.int32)), pa.py_buffer(flat)])
                starts = []
                for q, x in zip(piece.column(1).to_pylist(), sizes.tolist(), strict=True):
                    starts.append(at.get(q, 0))
                    at[q] = at.get(q, 0) + x
                first = pa.array(np.full(len(sizes), part))
                columns = [first, piece.column(0), piece.column(1), pa.array(starts, pa.int64()), pa.array(sizes), packed]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "queue", "local_start", "n_tokens", "ids"])

    return frames.Saved(
        docs.select("doc_id", _queue().alias("queue"), "text").mapInArrow(
            run, "part long, doc_id long, queue string, local_start long, n_tokens long, ids binary"
        )
    )


def _queue() -> Column:
    return F.concat(F.lit("s"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))


PATH = "queue string, node array<long>, left array<long>, is_left array<boolean>"


def _paths(sources: DataFrame) -> DataFrame:
    """The path of each source, of (queue, grp, n). A group has about one of `max_queues` parts of the sources."""

    def run(group):
        group = group.sort_values("queue")
        node, left, is_left = Tree.paths(group["n"].to_numpy())
        return group[["queue"]].assign(node=list(node), left=list(left), is_left=list(is_left))

    return sources.groupBy("grp").applyInPandas(run, PATH)


OUT = "doc_id long, start long, length long, doc_tokens long, source string, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, opt: Options) -> DataFrame:
    """Pieces: ids [start, start + length) of a document lie at `offset` of sequence `sequence_id`."""
    spark = docs.sparkSession
    saved = tokenise(docs, tokenizer_path, opt).df
    by_part = saved.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    starts = frames.Saved(
        by_part.select(
            "queue", "part", "n", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("part_start")
        )
    ).df
    sources = starts.groupBy("queue").agg(F.sum("n").alias("n"))
    few = sources.limit(opt.max_queues + 1).count() <= opt.max_queues
    weights = {f"s={k}": v for k, v in opt.weights}
    if not few:
        hashed = F.concat(F.lit("h="), F.pmod(F.xxhash64("queue"), F.lit(opt.max_queues)).cast("string"))
        sources = frames.Saved(
            sources.withColumn("grp", F.when(F.col("queue").isin(*weights), F.col("queue")).otherwise(hashed) if weights else hashed)
        ).df
    totals = {
        r["grp"]: r["n"] for r in sources.groupBy(F.col("queue" if few else "grp").alias("grp")).agg(F.sum("n").alias("n")).collect()
    }  # max_queues rows and one for each weight at most
    names = sorted(totals)
    all_tokens = max(1, sum(totals.values()))
    plan = Schedule([totals[q] for q in names], [weights.get(q, totals[q] / all_tokens) for q in names], opt.length)
    index = {q: i for i, q in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            step = max(1, min(1000, (4 << 20) * rb.num_rows // max(1, rb.column(5).nbytes)))
            for at in range(0, rb.num_rows, step):
                yield from _cut(rb.slice(at, step), plan, index)

    columns = ["doc_id", "queue", "local_start", "part_start", "n_tokens", "ids"]
    if few:
        placed = saved.join(starts.select("queue", "part", "part_start"), ["queue", "part"])
    else:
        starts = starts.select("queue", "part", "part_start").join(sources.select("queue", "grp"), "queue").join(_paths(sources), "queue")
        placed, columns = saved.join(starts, ["queue", "part"]), [*columns, "grp", "node", "left", "is_left"]
    return placed.select(*columns).mapInArrow(run, OUT)


def _cut(rb: pa.RecordBatch, plan: Schedule, index: dict[str, int]) -> Iterator[pa.RecordBatch]:
    tree = Tree.of(rb) if rb.num_columns > 6 else None
    queue = np.array([index[q] for q in rb.column(6 if tree else 1).to_pylist()], dtype=np.int64)
    begin = rb.column(2).to_numpy(zero_copy_only=False) + rb.column(3).to_numpy(zero_copy_only=False)
    n = rb.column(4).to_numpy(zero_copy_only=False)
    first, last = (plan.window(queue, tree.place(i) if tree else i) for i in (begin, begin + n - 1))
    per = last - first + 1
    row = np.repeat(np.arange(len(n)), per)
    w = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + first[row]
    packed = kernels.arrow_batch(rb.column(5))
    width = len(packed.buf) // int(n.sum())
    ids = np.frombuffer(packed.buf.tobytes(), f"<u{width}").astype("<u4")
    base = packed.off[:-1] // width
    source = pa.array([None if q == "s" else q[2:] for q in rb.column(1).to_pylist()], pa.string())
    step = max(1, min(100_000, (1 << 21) // len(plan.n)))
    for at in range(0, len(row), step):
        r, ww = row[at : at + step], w[at : at + step]
        edges, where = np.unique(np.concatenate((ww, ww + 1)), return_inverse=True)
        served = plan.served(edges)
        low, high = served[where[: len(ww)]], served[where[len(ww) :]]
        mine, here = queue[r], np.arange(len(r))
        earlier = np.arange(served.shape[1])[None, :] < mine[:, None]
        before = ((high - low) * earlier).sum(1)
        low, high = low[here, mine], high[here, mine]
        if tree:
            (low, low_before), (high, high_before) = tree.served(low, r), tree.served(high, r)
            before += high_before - low_before
        start = np.maximum(begin[r], low)
        stop = np.minimum(begin[r] + n[r], high)
        offset = before + start - low
        some = stop > start
        r, start, stop, offset, ww = r[some], (start - begin[r])[some], (stop - begin[r])[some], offset[some], ww[some]
        # a document's pieces follow each other, and so do the documents: the pieces lie one after the other in the ids
        edges4 = np.append(base[r] + start, base[r[-1]] + stop[-1] if len(r) else 0)
        low4 = int(edges4[0])
        pieces = pa.Array.from_buffers(
            pa.binary(), len(r), [None, pa.py_buffer(((edges4 - low4) * 4).astype(np.int32)), pa.py_buffer(ids[low4 : int(edges4[-1])])]
        )
        take = pa.array(r)
        yield pa.RecordBatch.from_arrays(
            [
                rb.column(0).take(take), pa.array(start), pa.array(stop - start), rb.column(4).take(take), source.take(take), pa.array(ww),
                pa.array(offset), pieces
            ],
            names=[c.split()[0] for c in OUT.split(", ")],
        )


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """The packed sequences: ids, and the pad ids that follow them where the length is no power of two."""
    whole = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", F.hex("ids").alias("hex")))).alias("p")
    )
    ids = F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), ""))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    power = n.bitwiseAND(n - 1) == 0
    return whole.select(
        "sequence_id", ids.alias("ids"), n.alias("n_tokens"), F.when(power, 0).otherwise(length - n).cast("int").alias("n_pad"),
        F.lit(pad_id).alias("pad_id")
    )


DOCUMENT = {"doc_id": "long", "text": "string", "source": "string"}


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = frames.pick(frames.table(spark, sf_dir, "documents"), **DOCUMENT)
    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json"), Options(end_id=0)))
