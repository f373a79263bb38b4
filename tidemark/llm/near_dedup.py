"""Near-duplicate groups by HyperMinHash.

A document is the set of its distinct word shingles. Documents with one set are one node, told
apart by a 128-bit digest, so exact copies cost one row each and no link. Every node has a sketch:
its shingle digests fall into `registers` buckets by their upper bits, and a register keeps the
least digest of its bucket as its count of leading zeros and the `mantissa` bits after the first one. Sketches
are banded. Nodes that share a band are candidates; their Jaccard index is estimated from equal
registers, less the share of registers that are expected to be equal by chance, and pairs
that could reach the threshold are verified on the full sets.

Pairs of a band are never rows. A node's centre score is the number of nodes that it meets in its
bands; an original scores above its edited copies.

1. Every node is paired with the most central node of its bands whose sketch allows a link. That closes most bands: those
   whose nodes all have one such centre.
2. In bands that are still open, nodes meet in blocks of bounded size. A block compares sketches and gives back a
   forest: fewer links than it has rows, which join all nodes whose sketches allow a link. The components of these
   candidate links hold every link.
3. The pairs of step 1 are verified on the full sets, and their links make components. In candidate components that
   still hold several of these, nodes meet in blocks again: intersections of full sets are counted for all pairs of a block at once by a product of
   0-1 matrices, and the block gives back a forest of its verified links.

Members of the component that holds most of a group are not compared with each other, so a group costs its minority
times its size, over blocks. A pair at the threshold exactly shares no band with a probability of
(1 - 0.8 ** rows) ** bands, 5e-8 here.

Defined results: null, empty and white texts have no shingles and are linked with nothing. Repeated rows
are one node and get the same group. A null doc_id never names a group that has another id;
a group of null ids alone has a null component_id and its rows are kept. A very long text takes some 40 bytes of memory for each of its
bytes. Ties (pairs at the threshold exactly) are linked. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames, kernels, union_find
from tidemark.llm.components import components


@dataclass(frozen=True)
class Options:
    shingle: int = 5
    percent: int = 80
    registers: int = 128
    band: int = 4
    mantissa: int = 10
    slack: float = 5.0
    block: int = 1024  # nodes of a group that are compared at once
    block_shingles: int = 1 << 20  # and their shingles


def distinct_shingles(b: kernels.Batch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle digests of each document, one after the other, and where each document's begin.

    Words are lower-cased in A-Z; a document of fewer words than `size`, but not none, is one shingle.
    """
    words = kernels.Words(b)
    pre = kernels.prefix(words.digests(51, fold_case=True))
    n = np.diff(words.first)
    length = np.minimum(n, size)
    per = np.where(n > 0, n - length + 1, 0)
    doc = np.repeat(np.arange(b.n), per)
    first = np.cumsum(per) - per
    start = np.arange(len(doc)) - first[doc] + words.first[:-1][doc]
    d = kernels.spans(pre, start, start + length[doc])
    for i, k in zip(first.tolist(), per.tolist(), strict=True):
        d[i : i + k].sort()
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (doc[1:] != doc[:-1])
    return d[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=b.n))))


def sketches(values: np.ndarray, first: np.ndarray, opt: Options) -> np.ndarray:
    """One row of registers for each set; 0 is an empty register."""
    n, m = len(first) - 1, opt.registers
    shift = np.uint64(64 - int(np.log2(m)))
    doc = np.repeat(np.arange(n), np.diff(first))
    slot = doc * m + (values >> shift).astype(np.int64)
    least = np.flatnonzero(np.diff(slot, prepend=-1))  # values are sorted, so a slot's first is its least
    v = values[least] << np.uint64(int(np.log2(m)))
    zeros = 64 - np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), v, side="right")
    rest = np.where(zeros >= 63, np.uint64(0), v << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - opt.mantissa)
    out = np.zeros(n * m, dtype=np.uint16)
    out[slot[least]] = 1 + (np.minimum(zeros, 62) << opt.mantissa) + rest.astype(np.int64)
    return out.reshape(n, m)


def chance(n_a: np.ndarray, n_b: np.ndarray, opt: Options) -> np.ndarray:
    """The probability that registers of two unrelated sets are equal: both leading-zero counts agree, and then the mantissas."""
    x = 2.0 ** -np.arange(60)

    def p(n: np.ndarray) -> np.ndarray:
        rate = (np.asarray(n, dtype=float) / opt.registers)[..., None]
        return np.exp(-rate * x / 2) - np.exp(-rate * x)

    return (p(n_a) * p(n_b)).sum(-1) / 2**opt.mantissa


STEPS = 8  # set sizes are rounded to an eighth of an octave where chances are looked up


def _chances(opt: Options) -> np.ndarray:
    """A table of `chance` by rounded set sizes."""
    c = kernels.cache()
    if ("chances", opt) not in c:
        n = 2.0 ** (np.arange(32 * STEPS) / STEPS)
        c["chances", opt] = np.stack([chance(np.full(len(n), x), n, opt) for x in n])
    return c["chances", opt]


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, opt: Options) -> tuple[np.ndarray, np.ndarray]:
    """The corrected estimate, and whether it reaches the threshold with `slack` standard errors in its favour. Sketches are rows."""
    used = ((a != 0) | (b != 0)).sum(-1)
    equal = ((a == b) & (a != 0)).sum(-1)
    by_chance = _chances(opt)[tuple(np.rint(np.log2(np.maximum(n, 1)) * STEPS).astype(np.int64) for n in (n_a, n_b))]
    estimate = (equal / np.maximum(used, 1) - by_chance) / (1 - by_chance)
    t = opt.percent / 100
    near_sizes = 100 * np.minimum(n_a, n_b) >= opt.percent * np.maximum(n_a, n_b)
    return estimate, near_sizes & (estimate + opt.slack * np.sqrt(t * (1 - t) / np.maximum(used, 1)) >= t)


def _sketch(docs: DataFrame, opt: Options) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part, b in kernels.chunks(rb, "text"):
                values, first = distinct_shingles(b, opt.shingle)
                n = np.diff(first)
                sums = [
                    np.concatenate(
                        (np.zeros(1, np.uint64), np.cumsum(kernels.mix(values ^ np.uint64(s)), dtype=np.uint64))
                    ) for s in (0x51ED270B, 0xA5A5F00D1)
                ]
                names = np.stack([kernels.mix(c[first[1:]] - c[first[:-1]] + n.astype(np.uint64)) for c in sums], axis=1)
                regs = sketches(values, first, opt)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([r.tobytes() for r in names], pa.binary()), pa.array(n),
                        pa.array([r.tobytes() for r in regs], pa.binary())
                    ],
                    names=["doc_id", "text_key", "node", "n", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, node binary, n long, sketch binary")


def _bands(nodes: DataFrame, opt: Options, keep: frames.Scratch) -> DataFrame:
    """(key, nid, centre) of every band that several nodes share."""
    width = 2 * opt.band
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(opt.registers // opt.band - 1)),
        lambda i: F.struct(i.alias("i"), F.substring("sketch", i * width + 1, F.lit(width)).alias("k"))
    )
    used = F.filter(keys, lambda x: x["k"] != F.lit(bytes(width)))
    every = nodes.select("nid", F.explode(F.transform(used, lambda x: F.xxhash64(x["i"], x["k"]))).alias("key"))
    sizes = every.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = keep(frames.join(every, sizes, ["key"]).select("key", "nid", "size"))
    centre = shared.groupBy("nid").agg(F.sum("size").alias("centre"))
    return keep(frames.join(shared, centre, ["nid"]).select("key", "nid", "centre"))


def _star_pairs(bands: DataFrame, nodes: DataFrame, opt: Options) -> DataFrame:
    """(nid, pivot, centre) of nodes and the most central node of one of their bands whose sketches allow a link; centre is the pivot's."""
    pivots = bands.groupBy("key").agg(F.max(F.struct("centre", "nid")).alias("p"))
    pairs = frames.join(bands, pivots, ["key"]).where("nid <> p.nid").select(
        "nid", F.col("p.nid").alias("pivot"), F.col("p.centre").alias("centre")
    ).distinct()
    a = nodes.select("nid", F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = nodes.select(F.col("nid").alias("pivot"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            s = [_registers(rb.column(k), opt) for k in (3, 4)]
            n = [rb.column(k).to_numpy() for k in (5, 6)]
            yield rb.select([0, 1, 2]).filter(pa.array(estimated(*s, *n, opt)[1]))

    near = F.lit(100) * F.least("n_a", "n_b") >= opt.percent * F.greatest("n_a", "n_b")
    both = frames.join(frames.join(pairs, a, ["nid"]), b, ["pivot"]).where(near)
    return both.select("nid", "pivot", "centre", "s_a", "s_b", "n_a", "n_b").mapInArrow(run, "nid long, pivot long, centre long")


def _registers(col: pa.Array, opt: Options) -> np.ndarray:
    """A column of sketches as rows of registers, without Python objects."""
    return kernels.arrow_batch(col).buf.view(np.uint8).copy().view(np.uint16).reshape(len(col), opt.registers)


def _meetings(members: DataFrame, by: str, block: Column, opt: Options) -> DataFrame:
    """Members of each group `by`, dealt into blocks that must meet: adds i, j (a pair of blocks) and mine (i or j).

    Members of one label need no comparison with each other, so the members with the group's major label are dealt into blocks of
    their own, which only meet the blocks of the others. `block` is the number of blocks that a count of members and their size take.
    """
    labels = members.groupBy(by, "label").agg(F.count("*").alias("m"), F.sum("weight").alias("w"))
    major = labels.groupBy(by).agg(
        F.max(F.struct("m", "label", "w")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w")
    ).where("top.m < m")
    blocks = major.select(
        by, F.col("top.label").alias("major"), block(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("minors"),
        block(F.col("top.m"), F.col("top.w")).alias("majors")
    )
    rows = frames.salted_join(members, blocks, by, "nid")
    is_major = F.col("label") == F.col("major")
    mine = F.when(
        is_major, F.col("minors") + F.pmod(F.xxhash64("nid"), "majors")
    ).otherwise(F.pmod(F.xxhash64("nid"), "minors")).cast("int")
    last = F.when(is_major, F.col("minors") - 1).otherwise(F.col("minors") + F.col("majors") - 1).cast("int")
    meets = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    return rows.select(by, "nid", "label", mine.alias("mine"), F.explode(meets).alias("at")).select(
        by, F.col("at.i").alias("i"), F.col("at.j").alias("j"), "mine", "nid", "label"
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows (group in the first three columns) as tables of whole groups of about `limit` bytes or more, with where groups begin."""
    held: list[pa.RecordBatch] = []
    for rb in batches:
        if not rb.num_rows:
            continue
        if held and sum(x.nbytes for x in held) >= limit:
            t = pa.Table.from_batches(held)
            edges = _edges(t)
            cut = int(edges[-1])
            if cut:
                yield t.slice(0, cut).combine_chunks(), edges[:-1]
                held = t.slice(cut).combine_chunks().to_batches()
        held.append(rb)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _edges(t)


def _edges(t: pa.Table) -> np.ndarray:
    new = np.ones(t.num_rows, dtype=bool)
    new[1:] = False
    for k in range(3):
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _pairs_in(begin: np.ndarray, end: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs x < y inside each [begin, end), about `step` of them at a time."""
    sizes = end - begin
    x = np.repeat(begin, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    per = np.repeat(end, sizes) - 1 - x
    total = np.cumsum(per)
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
        p = per[at:to]
        a = np.repeat(x[at:to], p)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(p) - p, p)
        at = to


def _forest(of: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """The links (a, b) between labels that make one class of all labels of a class; links inside a label are known already."""
    a, b = label, label[of]
    some = a != b
    pairs = np.unique(np.stack((a[some], b[some]), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _alike(rows: DataFrame, nodes: DataFrame, opt: Options) -> DataFrame:
    """Links (a, b) between the labels of nodes whose sketches allow a link: a forest of each block, fewer links than rows.

    Nodes that are joined already are not compared, so the pairs of a dense block are soon done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in _whole_groups(batches, 1 << 20):
            i, j, mine, label, n = (t.column(k).to_numpy() for k in (1, 2, 3, 5, 6))
            s = _registers(t.column(7), opt)
            end = np.append(begin[1:], t.num_rows)
            group = np.repeat(np.arange(len(begin)), end - begin)
            of = union_find.classes(np.arange(len(label)), *_same(group, label))
            for x, y in _pairs_in(begin, end, 1 << 14):
                some = (of[x] != of[y]) & ((i[x] == j[x]) | (mine[x] != mine[y])) & (
                    100 * np.minimum(n[x], n[y]) >= opt.percent * np.maximum(n[x], n[y])
                )
                x, y = x[some], y[some]
                if len(x):
                    able = estimated(s[x], s[y], n[x], n[y], opt)[1]
                    if able.any():
                        of = union_find.classes(of, x[able], y[able])
            yield _forest(of, label)

    sketched = frames.join(rows, nodes.select("nid", "n", "sketch"), ["nid"]).select("key", "i", "j", "mine", "nid", "label", "n", "sketch")
    return sketched.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _same(group: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between places that agree in both."""
    order = np.lexsort((label, group))
    a, b = order[:-1], order[1:]
    same = (group[a] == group[b]) & (label[a] == label[b])
    return a[same], b[same]


def linked(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets (sorted distinct digests) with 100 * intersection >= percent * union, by exact counts.

    With left, only pairs of a set that is left and one that is not. Shingles that one set alone has are in no intersection, and sets
    without enough others are dropped; what is left is multiplied as a 0-1 matrix, some columns at a time.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    if m == 2 or left is not None and min(left.sum(), m - left.sum()) == 1:
        one = 0 if m == 2 else int(np.flatnonzero(left)[0] if left.sum() == 1 else np.flatnonzero(~left)[0])
        other = np.array([k for k in range(m) if k != one])
        both = np.array([_common(sets[one], sets[k]) for k in other.tolist()], dtype=np.int64)
        ok = 100 * both >= percent * (size[one] + size[other] - both)
        return np.full(int(ok.sum()), one), other[ok]
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    live = np.ones(m, dtype=bool)
    while True:
        shared = np.bincount(column)[column] > 1
        column, owner = column[shared], owner[shared]
        keep = 100 * np.bincount(owner, minlength=m) >= percent * size
        if keep[owner].all():
            live &= keep
            break
        column, owner = column[keep[owner]], owner[keep[owner]]
    names = np.flatnonzero(live)
    place = np.zeros(m, dtype=np.int64)
    place[names] = np.arange(len(names))
    _, column = np.unique(column, return_inverse=True)
    width = 2048
    both = np.zeros((len(names), len(names)), dtype=np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for c, (p, q) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        x = np.zeros((len(names), width), dtype=np.float32)
        x[place[owner[p:q]], column[p:q] - c * width] = 1
        both += x @ x.T
    n = size[names]
    a, b = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
    a, b = names[a], names[b]
    if left is not None:
        cross = left[a] != left[b]
        a, b = a[cross], b[cross]
    return a, b


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(y):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _verified(rows: DataFrame, sets: DataFrame, by: str, opt: Options) -> DataFrame:
    """Links (a, b) between the labels of nodes that are linked by their full sets: a forest of each block, fewer links than rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in _whole_groups(batches, 1 << 20):
            i, j, mine, label = (t.column(k).to_numpy() for k in (1, 2, 3, 5))
            b = kernels.arrow_batch(t.column(6))
            values, off = np.frombuffer(b.buf.tobytes(), np.uint64), b.off // 8
            end = np.append(begin[1:], t.num_rows)
            of = np.arange(len(label))
            for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
                if hi - lo < 2:
                    continue
                own = [values[off[k] : off[k + 1]] for k in range(lo, hi)]
                x, y = linked(own, opt.percent, None if i[lo] == j[lo] else mine[lo:hi] == i[lo])
                of = union_find.classes(of, x + lo, y + lo) if len(x) else of
            yield _forest(of, label)

    full = frames.join(rows, sets, ["nid"]).select(by, "i", "j", "mine", "nid", "label", "set")
    return full.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, opt: Options) -> DataFrame:
    """The full shingle sets (sorted 64-bit digests) of the wanted nodes (nid, doc, text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part, b in kernels.chunks(rb, "text"):
                values, first = distinct_shingles(b, opt.shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), _packed(values, first)], names=["nid", "set"])

    one = frames.join(docs.select(F.col("doc_id").alias("doc"), "text_key", "text"), wanted, ["doc", "text_key"])
    return one.select("nid", "text").mapInArrow(run, "nid long, set binary")


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    off = first * 8
    kind = pa.large_binary() if off[-1] >= 1 << 31 else pa.binary()
    return pa.Array.from_buffers(
        kind, len(first) - 1,
        [None, pa.py_buffer(off.astype(np.int64 if kind == pa.large_binary() else np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )


NO_ID = -(2**63)


def groups(docs: DataFrame, opt: Options = Options()) -> frames.Saved:
    """Saved table (doc_id, text_key, n_shingles, component_id, first), a row for each row of the input; doc_id null is the least long.

    `first` marks the rows of the one (doc_id, text_key) that stands for its group: its smallest doc_id, known ones before null, then the smallest text_key.
    """
    docs = docs.select(
        frames.null_first_id("doc_id").alias("doc_id"), frames.text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")
    )
    with frames.Scratch() as keep:
        return _groups(docs, opt, keep)


def _groups(docs: DataFrame, opt: Options, keep: frames.Scratch) -> frames.Saved:
    rows = keep(_sketch(docs, opt))
    known = F.when(F.col("doc_id") == F.lit(NO_ID), None).otherwise(F.col("doc_id"))
    least = F.min(F.struct(known.isNull().alias("none"), "doc_id", "text_key", "n", "sketch")).alias("r")
    nodes = keep(
        rows.where("n > 0").groupBy("node").agg(least).select(
            "node", F.monotonically_increasing_id().alias("nid"), "r.none", F.col("r.doc_id").alias("doc"), "r.text_key", "r.n", "r.sketch"
        )
    )
    bands = _bands(nodes, opt, keep)

    best = _star_pairs(bands, nodes, opt).groupBy("nid").agg(F.max(F.struct("centre", "pivot")).alias("p"))
    own = bands.groupBy("nid").agg(F.first("centre").alias("centre"))
    me = F.struct("centre", F.col("nid").alias("pivot"))
    loose = keep(frames.join(own, best, ["nid"], "left").select("nid", F.greatest(me, F.coalesce("p", me))["pivot"].alias("label")))
    stars = loose.where("nid <> label").withColumnRenamed("label", "pivot")
    members = frames.join(bands.select("key", "nid"), loose, ["nid"]).withColumn("weight", F.lit(0))
    meetings = _meetings(members, "key", lambda m, w: F.ceil(m / opt.block), opt)
    candidates = keep(stars.select(F.col("nid").alias("a"), F.col("pivot").alias("b")).union(_alike(meetings, nodes, opt)).distinct())
    loose = components(candidates)  # every link lies in one of these

    wanted = frames.join(nodes, loose, ["nid"], "left_semi")
    sets = keep(_sets(docs, wanted.select("nid", "doc", "text_key"), opt).dropDuplicates(["nid"]))
    parts = stars.groupBy("pivot").agg(F.ceil(F.count("*") / opt.block).cast("int").alias("parts"))
    spread = frames.join(stars, parts, ["pivot"]).select(
        F.col("pivot").alias("key"), F.lit(0).alias("i"), (1 + F.pmod(F.xxhash64("nid"), "parts")).cast("int").alias("j"), "nid"
    )
    centres = parts.select(
        F.col("pivot").alias("key"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(1), "parts")).alias("j"), F.lit(0).alias("mine"),
        F.col("pivot").alias("nid")
    )
    star_rows = spread.select("key", "i", "j", F.col("j").alias("mine"), "nid").unionByName(centres).withColumn("label", F.col("nid"))
    links = keep(_verified(star_rows, sets, "key", opt))
    tight = components(links)

    weights = nodes.select("nid", F.col("n").alias("weight"))
    members = frames.join(loose.withColumnRenamed("label", "loose"), tight, ["nid"], "left")
    members = frames.join(members.select("nid", "loose", F.coalesce("label", "nid").alias("label")), weights, ["nid"])
    meetings = _meetings(members, "loose", lambda m, w: F.ceil(F.greatest(m / opt.block, w / opt.block_shingles, F.lit(1.0))), opt)
    more = keep(_verified(meetings, sets, "loose", opt))
    labels = components(links.union(more)) if more.limit(1).count() else tight

    me = F.struct("none", "doc", "text_key")
    linked = keep(frames.join(nodes, labels, ["nid"]).select("node", "nid", "label", "none", "doc", "text_key"))
    named = linked.groupBy("label").agg(F.min(me).alias("r"))
    grouped = frames.salted_join(linked, named, "label", "nid").select("node", "r")
    by_node = grouped.unionByName(frames.join(nodes, labels, ["nid"], "left_anti").select("node", me.alias("r")))
    stands = F.coalesce((F.col("doc_id") == F.col("r.doc")) & (F.col("text_key") == F.col("r.text_key")), F.lit(True))
    group = F.when(F.col("n") == 0, known).when(~F.col("r.none"), F.col("r.doc"))
    return frames.Saved(
        frames.join(rows, by_node, ["node"], "left").select(
            "doc_id", "text_key", F.col("n").alias("n_shingles"), group.alias("component_id"), stands.alias("first")
        )
    )


def _id() -> Column:
    return F.when(F.col("doc_id") == F.lit(NO_ID), None).otherwise(F.col("doc_id"))


def keep_one(docs: DataFrame, opt: Options, columns: tuple[str, ...]) -> DataFrame:
    """The given columns of one document of each group: the row that is `first`, and of rows alike in id and text the least by all columns."""
    stay = groups(docs, opt).df.where("first").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    left = docs.select(F.struct(*columns).alias("_row"), frames.null_first_id("doc_id").alias("_id"), frames.text_key().alias("_key"))
    chosen = frames.join(left, stay, ["_id", "_key"], "left_semi")
    return chosen.groupBy("_id", "_key").agg(F.min("_row").alias("_row")).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = groups(frames.pick(frames.table(spark, sf_dir, "documents"), doc_id="long", text="string"), Options(shingle=2)).df
    doc = _id()
    return found.select(
        doc.alias("doc_id"), "n_shingles", "component_id",
        F.coalesce(doc == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    )
