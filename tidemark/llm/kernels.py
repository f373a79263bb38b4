"""Vectorised text kernels on Arrow buffers: words, digests of any span, rolling digests.

A batch of texts is one UTF-8 byte buffer and an array of document offsets, so a kernel runs
over all documents of a batch at once. Digests of a span are differences of prefix sums of a
polynomial modulo 2**64, divided by the power at the span's start; two of them with independent
coefficients give 128 bits.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa

#: A chunk's arrays take up to some 50 bytes for each byte of it, beside the buffers of one Arrow batch.
CHUNK_BYTES = 512 << 10
_U = np.uint64


def cache() -> dict:
    """A per-process cache that survives from task to task in a reused Python worker."""
    return sys.__dict__.setdefault("_tidemark_llm_cache", {})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (shift-multiply rounds)."""
    x = (x ^ (x >> _U(31))) * _U(0x9FB21C651E98DF25)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


#: Any odd number does: its powers modulo 2**64 can be undone.
_BASE = 0x2545F4914F6CDD1D
#: Arrays are worked through in slabs that fit a core's cache, with one table of powers for all of them.
_BITS = 15
SLAB = 1 << _BITS


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The first SLAB powers of the base, and of its inverse modulo 2**64."""
    c = cache()
    if "powers" not in c:
        c["powers"] = tuple(_power_table(b, SLAB) for b in (_BASE, pow(_BASE, -1, 2**64)))
    return c["powers"]


def _power_table(b: int, n: int) -> np.ndarray:
    p = np.full(max(1, n), b, dtype=_U)
    p[0] = 1
    return np.multiply.accumulate(p)


def _slab_powers(n: int, inverse: bool) -> np.ndarray:
    """The powers at the beginning of each slab of n places."""
    b = pow(_BASE, -1, 2**64) if inverse else _BASE
    return _power_table(pow(b, SLAB, 2**64), n // SLAB + 1)


def byte_table(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; with fold_case, A-Z get the values of a-z."""
    t = np.random.default_rng(seed + 7).integers(1, 2**63, 256).astype(_U) * _U(2) + _U(1)
    if fold_case:
        t[65:91] = t[97:123]
    return t


def trim() -> None:
    """Gives memory that is free back to the system; a worker lives on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    c = cache()
    if "trim" not in c:
        try:
            c["trim"] = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # another C library
            c["trim"] = None
    if c["trim"] is not None:
        c["trim"](0)


class Batch:
    """Texts as one buffer. `off` has n + 1 offsets into `buf`."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1

    @staticmethod
    def of(texts: list[bytes]) -> Batch:
        off = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        return Batch(np.frombuffer(b"".join(texts), dtype=np.uint8), off)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def arrow_batch(col: pa.Array) -> Batch:
    """A string or binary column (null: empty) as a Batch, without a copy where it has no nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(off):
        off = np.zeros(1, np.int64)
    return Batch(whole[off[0] : off[-1]], off - off[0])


def gathered(batches, limit: int):
    """Record batches joined up to about `limit` bytes each."""
    held, size = [], 0
    for rb in batches:
        if not rb.num_rows:
            continue
        if held and size + rb.nbytes > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, size = [], 0
        held.append(rb)
        size += rb.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def chunks(rb: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES):
    """Slices of a record batch with about `limit` bytes of text each, with their text Batch."""
    if not rb.num_rows:
        return
    off = arrow_batch(rb.column(rb.schema.get_field_index(text))).off
    at = 0
    while at < rb.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        part = rb.slice(at, to - at)
        yield part, arrow_batch(part.column(part.schema.get_field_index(text)))
        at = to
    trim()


#: Fixed values of the query contracts: bytes that part words.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def separator_table(kind: str) -> np.ndarray:
    """True for bytes that are in no word. `space`: [\\x20\\x09-\\x0D]. `alnum`: every ASCII byte but 0-9, A-Z and a-z."""
    t = np.zeros(256, dtype=bool)
    if kind == "space":
        t[list(SPACES)] = True
    else:
        t[:128] = True
        t[48:58] = t[65:91] = t[97:123] = False
    return t


class Words:
    """Words of a Batch: byte spans [start, end), `first[i]:first[i + 1]` are document i's."""

    def __init__(self, b: Batch, kind: str = "space"):
        inside = ~separator_table(kind)[b.buf]
        n = len(inside)
        edge = np.ones(n + 1, dtype=bool)  # a word may begin or end here
        if n:
            np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
        edge[b.off] = True  # no word crosses a document's edge
        self.start = np.flatnonzero(edge[:n] & inside)
        self.end = np.flatnonzero(edge[1:] & inside) + 1
        self.first = np.searchsorted(self.start, b.off)
        self.batch = b

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.batch.n), np.diff(self.first))

    def digests(self, seed: int, fold_case: bool = False) -> np.ndarray:
        return span_digests(self.batch.buf, self.start, self.end, seed, fold_case)


def prefix(values: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Prefix sums of the polynomial over values (or table[values]): 8 bytes a value and one slab."""
    n = len(values)
    p, high = _powers()[0], _slab_powers(n, inverse=False)
    out = np.zeros(n + 1, dtype=_U)
    for k, at in enumerate(range(0, n, SLAB)):
        v = values[at : at + SLAB]
        v = (v if table is None else table[v]) * p[: len(v)]
        v *= high[k]
        own = out[at + 1 : at + 1 + len(v)]
        np.cumsum(v, out=own)
        own += out[at]
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of [start, end) from the prefix sums; the length is part of the digest."""
    inv, high = _powers()[1], _slab_powers(len(pre), inverse=True)
    out = np.empty(len(start), dtype=_U)
    for at in range(0, len(start), SLAB):
        s, e = start[at : at + SLAB], end[at : at + SLAB]
        d = (pre[e] - pre[s]) * inv[s & (SLAB - 1)]
        if len(high) > 1:
            d *= high[s >> _BITS]
        out[at : at + SLAB] = mix(d + (e - s).astype(_U) * _U(0xA24BAED4963EE407))
    return out


def span_digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, fold_case: bool = False) -> np.ndarray:
    return spans(prefix(buf, byte_table(seed, fold_case)), start, end)


def windows(words: Words, size: int) -> np.ndarray:
    """Indices of the words that start a window of `size` words within one document."""
    n = len(words.start)
    last = np.repeat(words.first[1:], np.diff(words.first))
    at = np.arange(n)
    return at[at + size <= last]


def cover(n: int, starts: np.ndarray, size) -> np.ndarray:
    """True for each of n places inside any [start, start + size)."""
    if not len(starts):
        return np.zeros(n, dtype=bool)
    d = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + size, n), minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def rolling(pre: np.ndarray, size: int) -> np.ndarray:
    """Digests of every span of `size` places, from the prefix sums; as `spans` gives them."""
    n = len(pre) - size
    out = np.empty(max(0, n), dtype=_U)
    inv, high = _powers()[1], _slab_powers(len(pre), inverse=True)
    for k, at in enumerate(range(0, n, SLAB)):
        e = min(n, at + SLAB)
        d = (pre[at + size : e + size] - pre[at:e]) * inv[: e - at]
        d *= high[k]
        d += _U(size * 0xA24BAED4963EE407 % 2**64)
        out[at:e] = mix(d)
    return out


def pieces(rb: pa.RecordBatch, text: str, overlap: int, limit: int = CHUNK_BYTES):
    """(rows, where their pieces begin, Batch) of about `limit` bytes; a longer text comes in pieces that share `overlap` bytes.

    A piece begins at every multiple of `limit`, so each place is the begin of a span of up to overlap + 1 bytes in one piece alone.
    """
    whole = arrow_batch(rb.column(rb.schema.get_field_index(text)))
    held: list[int] = []

    def together() -> tuple[np.ndarray, np.ndarray, Batch]:
        lo, hi = held[0], held[-1] + 1
        off = whole.off[lo : hi + 1]
        return np.arange(lo, hi), np.zeros(hi - lo, np.int64), Batch(whole.buf[off[0] : off[-1]], off - off[0])

    size = 0
    for row, (a, e) in enumerate(zip(whole.off[:-1].tolist(), whole.off[1:].tolist(), strict=True)):
        if held and size + e - a > limit:
            yield together()
            held, size = [], 0
        if e - a <= limit:
            held.append(row)
            size += e - a
            continue
        for at in range(0, max(1, e - a - overlap), limit):
            piece = whole.buf[a + at : min(e, a + at + limit + overlap)]
            yield np.array([row]), np.array([at]), Batch(piece, np.array([0, len(piece)]))
    if held:
        yield together()
    trim()
