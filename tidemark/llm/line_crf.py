"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad. A line's features are bins of its shape (lengths, shares of kinds of bytes,
repeated and common words) and the same bins of the lines before and after it. Forward-backward gives each line's
marginal probability of being good; a document's quality is their mean, weighted by line length, put
through a logistic calibration. Labels are of documents, so a training document's lines all carry its label.

The model is fitted on a bounded sample (the `Options.sample` labelled documents with the least hashes of their ids, of these the ones of at most
`Options.longest` bytes). Scores are a function of the text alone.

Defined results: lines without a word are left out; a document without lines (null, empty) gets the score of the
prior share of good labels. Labels other than 0 and 1, null ids and ids without a document are not learnt from.
Without labels of both kinds all scores are 0.5. Repeated rows are scored alike. A very long text is scored as a whole, with some
300 bytes of memory for each of its lines. Ties have no effect. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames, kernels
from tidemark.llm.quality_rules import COMMON


@dataclass(frozen=True)
class Options:
    sample: int = 4000
    longest: int = 100_000
    rounds: int = 60
    l2: float = 1e-3
    bins: int = 8


KINDS = 6  # bytes: lower, upper, digit, mark, symbol, wide


def _kinds() -> np.ndarray:
    t = np.full(256, -1, dtype=np.int64)
    t[97:123], t[65:91], t[48:58], t[128:] = 0, 1, 2, 5
    t[33:48] = t[58:65] = t[91:97] = t[123:127] = 4
    t[list(b".,;:'\"-()?")] = 3
    return t


def measure(b: kernels.Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that have a word (rows), their lengths in bytes, and where each document's lines begin."""
    size = len(b.buf)
    cut = np.flatnonzero(b.buf == 10)
    begin = np.unique(np.concatenate((b.off[:-1], cut + 1)))
    begin = begin[begin < size]
    end = np.minimum(np.append(begin[1:], size), np.append(cut, size)[np.searchsorted(cut, begin)])
    words = kernels.Words(b)
    lo, hi = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
    some = hi > lo
    begin, end, lo, hi = begin[some], end[some], lo[some], hi[some]
    n = len(begin)
    first = np.searchsorted(begin, b.off)

    def share(mask: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[e] - c[a]) / np.maximum(e - a, 1)

    kind = _kinds()[b.buf]
    cols = [share(kind == k, begin, end) for k in range(KINDS)]
    cols.append(share(b.buf == ord("|"), begin, end))
    d = words.digests(71, fold_case=True)
    again = np.zeros(len(d), dtype=bool)
    again[1:] = d[1:] == d[:-1]
    cols.append(share(again, lo, hi))
    line = np.repeat(np.arange(n), hi - lo)
    inside = np.concatenate([np.arange(a, e) for a, e in zip(lo.tolist(), hi.tolist(), strict=True)]) if n else np.zeros(0, np.int64)
    different = np.zeros(n)
    if n:
        pair = np.unique(kernels.mix(d[inside] ^ kernels.mix(line.astype(np.uint64))) & np.uint64(2**64 - 1), return_index=True)[1]
        different = np.bincount(line[pair], minlength=n)
    cols.append(different / np.maximum(hi - lo, 1))
    listed = kernels.Batch.of([w.encode() for ws in COMMON.values() for w in ws])
    known = np.unique(kernels.span_digests(listed.buf, listed.off[:-1], listed.off[1:], 71, fold_case=True))
    pos = np.minimum(np.searchsorted(known, d), len(known) - 1)
    cols.append(share(known[pos] == d, lo, hi))
    length = words.end - words.start
    cols.append((np.concatenate(([0], np.cumsum(length)))[hi] - np.concatenate(([0], np.cumsum(length)))[lo]) / np.maximum(hi - lo, 1))
    cols.append(np.log1p(hi - lo))
    text = kernels.mix(
        kernels.span_digests(b.buf, begin, end, 73) ^ kernels.mix(np.searchsorted(b.off, begin, side="right").astype(np.uint64))
    )
    _, back, count = np.unique(text, return_inverse=True, return_counts=True)
    cols.append((count[back] > 1).astype(float) if n else np.zeros(0))
    return np.stack(cols, axis=1) if n else np.zeros((0, len(cols))), (end - begin).astype(float), first


class Model:
    """Bins, weights (good against bad), the transition weights and the calibration."""

    def __init__(self, edges: np.ndarray, opt: Options):
        self.edges, self.opt = edges, opt  # (features, bins - 1)
        self.w = np.zeros((3, len(edges), opt.bins))
        self.start, self.stay = 0.0, np.zeros((2, 2))
        self.scale, self.shift, self.prior = 0.0, 0.0, 0.5

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1
        ) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def unary(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        k = np.arange(bins.shape[1])
        own, before, after = (self.w[j][k, bins].sum(1) for j in range(3))
        out = own.copy()
        begins, ends = np.zeros(len(bins), bool), np.zeros(len(bins), bool)
        full = first[1:] > first[:-1]
        begins[first[:-1][full]], ends[first[1:][full] - 1] = True, True
        out[1:] += np.where(begins[1:], 0, before[:-1])
        out[:-1] += np.where(ends[:-1], 0, after[1:])
        return out

    def marginals(self, unary: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and of neighbouring lines in state (i, j) summed over each document's pairs."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        longest = int(n.max(initial=0))
        score = np.stack((np.zeros(len(unary)), unary), axis=1)
        score[first[:-1][n > 0], 1] += self.start
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        live = np.searchsorted(-n[order], -np.arange(1, longest + 1), side="right")  # documents with so many lines
        trans = self.stay[None]
        for t in range(longest):
            at = first[:-1][order[: live[t]]] + t
            alpha[at] = score[at] if t == 0 else score[at] + np.logaddexp(
                alpha[at - 1, 0, None] + trans[:, 0], alpha[at - 1, 1, None] + trans[:, 1]
            )
        for t in range(longest - 2, -1, -1):
            at = first[:-1][order[: live[t + 1]]] + t
            nxt = score[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(trans[:, :, 0] + nxt[:, 0, None], trans[:, :, 1] + nxt[:, 1, None])
        good = 1 / (1 + np.exp(np.clip((alpha + beta)[:, 0] - (alpha + beta)[:, 1], -60, 60)))
        inner = np.ones(len(unary), dtype=bool)
        inner[first[:-1][n > 0]] = False
        at = np.flatnonzero(inner)
        pair = alpha[at - 1][:, :, None] + trans + (score[at] + beta[at])[:, None, :]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True)) if len(at) else pair
        return good, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(0) if len(at) else np.zeros((2, 2))

    def raw(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; NaN without lines."""
        good, _ = self.marginals(self.unary(self.bins(x), first), first)
        s, w = (np.concatenate(([0], np.cumsum(v))) for v in (good * length, length))
        with np.errstate(invalid="ignore"):
            return (s[first[1:]] - s[first[:-1]]) / (w[first[1:]] - w[first[:-1]])

    def scores(self, b: kernels.Batch) -> np.ndarray:
        q = self.raw(*measure(b))
        p = 1 / (1 + np.exp(-np.clip(self.scale * (np.nan_to_num(q) - 0.5) + self.shift, -50, 50)))
        return np.where(np.isnan(q), self.prior, p)


def _measure_all(texts: list[bytes], step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The measures of many texts, about `step` bytes at a time, so that the driver holds the arrays of few bytes."""
    xs, lengths, firsts, lines, held, size = [], [], [np.zeros(1, np.int64)], 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= step or i + 1 == len(texts):
            x, length, first = measure(kernels.Batch.of(held))
            xs.append(x)
            lengths.append(length)
            firsts.append(first[1:] + lines)
            lines += len(x)
            held, size = [], 0
    if not xs:
        return measure(kernels.Batch.of([]))
    return np.concatenate(xs), np.concatenate(lengths), np.concatenate(firsts)


def fit(texts: list[bytes], labels: list[int], opt: Options = Options()) -> Model:
    """Maximum likelihood of the line labels by gradient steps with momentum (Adam), then the calibration."""
    x, length, first = _measure_all(texts)
    y = np.array(labels, dtype=float)
    if not len(x) or len(set(labels)) < 2:
        return Model(np.zeros((13, opt.bins - 1)), opt)
    m = Model(np.stack([np.quantile(v, np.linspace(0, 1, opt.bins + 1)[1:-1]) for v in x.T]), opt)
    bins = m.bins(x)
    line_y = np.repeat(y, np.diff(first))
    n = np.diff(first)
    weight = np.repeat(
        np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / np.maximum(n, 1), n
    )  # both labels alike
    inner = np.ones(len(x), dtype=bool)
    inner[first[:-1][n > 0]] = False
    last = np.append(inner[1:], False)  # has a line after it
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_y[inner].astype(int), line_y[inner].astype(int)), 1)
    params = [m.w, np.zeros(1), m.stay]
    mom, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, opt.rounds + 1):
        m.start = float(params[1][0])
        good, pairs = m.marginals(m.unary(bins, first), first)
        err = (good - line_y) * weight
        grad = np.zeros_like(m.w)
        for k in range(bins.shape[1]):
            grad[0, k] = np.bincount(bins[:, k], err, minlength=opt.bins)
            at = np.flatnonzero(inner)
            grad[1, k] = np.bincount(bins[at - 1, k], err[at], minlength=opt.bins)
            at = np.flatnonzero(last)
            grad[2, k] = np.bincount(bins[at + 1, k], err[at], minlength=opt.bins)
        grads = [grad + opt.l2 * m.w, np.array([err[first[:-1][n > 0]].sum()]), (pairs - seen) / max(1, inner.sum()) + 0.05 * m.stay]
        for p, g, a, v in zip(params, grads, mom, var, strict=True):
            a += 0.1 * (g - a)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    m.start = float(params[1][0])
    q = m.raw(x, length, first)
    ok = ~np.isnan(q)
    m.prior = float(y.mean())
    q, t = q[ok] - 0.5, y[ok]
    a = c = 0.0
    balance = np.where(t == 1, 0.5 / max(1, (t == 1).sum()), 0.5 / max(1, (t == 0).sum()))
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(a * q + c, -50, 50)))
        a -= 20 * (((p - t) * q * balance).sum() + 1e-4 * a)
        c -= 5 * ((p - t) * balance).sum()
    m.scale, m.shift = float(a), float(c)
    return m


def training_rows(docs: DataFrame, labels: DataFrame, opt: Options) -> tuple[list[bytes], list[int]]:
    """The labelled documents with the opt.sample least hashes of doc_id, in that order; of rows with one id the least text."""
    named = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    chosen = named.orderBy("h", "doc_id", "quality").limit(opt.sample)  # bounded, and all of it that is ever joined
    few = docs.where(F.octet_length("text") <= opt.longest).join(F.broadcast(chosen), "doc_id")
    rows = few.groupBy("h", "doc_id", "quality").agg(F.min("text").alias("text")).orderBy("h", "doc_id", "quality").limit(opt.sample).collect()
    return [r["text"].encode() for r in rows], [r["quality"] for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of each document."""
    shipped = frames.Shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for rb in batches:
            for part, b in kernels.chunks(rb, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(b))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = frames.pick(frames.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    labels = frames.pick(frames.table(spark, sf_dir, "labels"), doc_id="long", quality="int")
    held_out = frames.crc32_mod(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 3) == 1
    model = fit(*training_rows(docs, labels.where(~held_out), Options()))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
