"""Cutting plain texts into a byte-level BPE's pieces, and a table of the pieces' ids, in numpy.

A piece of up to 16 bytes is its own key: its bytes as two 64-bit integers, so equal keys are equal
pieces. The table is open addressing with linear probing, worked through many keys at a time; a
key's row also says where its ids lie in one long array of ids.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm import kernels

#: The longest piece that has a key.
LONGEST = 16
#: With its ids a table of so many pieces takes some 160 MB; a full one is emptied.
MOST = 2_400_000
#: Pieces that are looked up at a time, so that arrays of pieces stay small in a very long text.
SLAB = 1 << 16

_U = np.uint64
_WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_MASKS = np.array([(1 << 8 * min(n, 16)) - 1 for n in range(LONGEST + 1)], dtype=object)
_LOW, _HIGH = (_MASKS & (2**64 - 1)).astype(_U), (_MASKS >> 64).astype(_U)


def classes(letters: str, digits: str, marks: str, white: str) -> np.ndarray:
    """The class of each byte. Of two-byte letters those after 0xC3 are known, but for 0xC3 0x97 and 0xC3 0xB7, the signs among them."""
    out = np.full(256, _OTHER, dtype=np.uint8)
    for chars, kind in ((letters, _LETTER), (digits, _DIGIT), (marks, _MARK), (white, _WHITE)):
        out[np.frombuffer(chars.encode("ascii"), dtype=np.uint8)] = kind
    out[0x80:0xC0] = out[0xC3] = _LETTER
    return out


def cut(text: kernels.Batch, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of all texts begin, and which texts are plain (a text that is not is one piece).

    A piece is a run of letters, digits or marks with the space before it, if there is one; of a run of white
    space what is before that space, or before its last character, is a piece, as is a run at a text's end.
    """
    buf, n = text.buf, len(text.buf)
    kind = kinds.take(buf)
    begins = text.off[:-1][np.diff(text.off) > 0]
    odd = kind == _OTHER
    sign = (buf[1:] == 0x97) | (buf[1:] == 0xB7)
    sign &= buf[:-1] == 0xC3
    odd[1:] |= sign
    plain = np.ones(text.n, dtype=bool)
    plain[np.searchsorted(text.off, np.flatnonzero(odd), side="right") - 1] = False
    start = np.zeros(n, dtype=bool)
    white = kind == _WHITE
    start[1:] = kind[1:] != kind[:-1]
    start[1:] &= buf[:-1] != 32  # that space is where the piece begins
    last = white[:-1] & ~white[1:]  # the last white character before a run
    last[begins[1:] - 1] = False
    start[:-1] |= last
    start[begins] = True
    if not plain.all():
        start &= np.repeat(plain, np.diff(text.off))
        start[begins] = True
    return np.flatnonzero(start), plain


def keys(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each span of at most LONGEST bytes as two integers."""
    words = np.zeros(len(buf) // 8 + 4, dtype="<u8")
    words.view(np.uint8)[: len(buf)] = buf
    at, shift = start >> 3, ((start & 7) << 3).astype(_U)
    back = _U(63) - shift
    a, b, c = words.take(at), words.take(at + 1), words.take(at + 2)
    low = (a >> shift) | ((b << _U(1)) << back)
    high = (b >> shift) | ((c << _U(1)) << back)
    return low & _LOW.take(size), high & _HIGH.take(size)


class Table:
    """ids by key. `rows` has (key, key, first id, number of ids); a first key of 0 is an empty row."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.n, self.bits, self.used = 0, 16, 0
        self.rows = np.zeros((1 << self.bits, 4), dtype=_U)
        self.ids = np.zeros(1 << 16, dtype="<u4")

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (digest(low, high) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id, number of ids, and whether the key is there."""
        slot = self._slot(low, high)
        rows = self.rows.take(slot, axis=0)
        hit = (rows[:, 0] == low) & (rows[:, 1] == high)
        first, count = rows[:, 2].astype(np.int64), rows[:, 3].astype(np.int64)
        left = np.flatnonzero(~hit & (rows[:, 0] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            rows = self.rows.take(slot[left], axis=0)
            same = (rows[:, 0] == low[left]) & (rows[:, 1] == high[left])
            done = left[same]
            hit[done], first[done], count[done] = True, rows[same, 2], rows[same, 3]
            left = left[~same & (rows[:, 0] != 0)]
        return first, count, hit

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Distinct keys that are not there yet, with their ids one after the other."""
        rows = np.stack([low, high, (self.used + np.cumsum(count) - count).astype(_U), count.astype(_U)], axis=1)
        if self.used + len(ids) > len(self.ids):
            more = np.zeros(max(2 * len(self.ids), self.used + len(ids)), dtype="<u4")
            more[: self.used] = self.ids[: self.used]
            self.ids = more
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.n = self.used + len(ids), self.n + len(low)
        if 5 * self.n > 3 << self.bits:
            old = self.rows
            while 5 * self.n > 3 << self.bits:
                self.bits += 1
            self.rows = np.zeros((1 << self.bits, 4), dtype=_U)
            self._put(old[old[:, 0] != 0])
        self._put(rows)

    def _put(self, rows: np.ndarray) -> None:
        slot = self._slot(rows[:, 0], rows[:, 1])
        while len(rows):
            free = np.flatnonzero(self.rows[slot, 0] == 0)
            self.rows[slot[free]] = rows[free]  # of several with one slot, one stays
            now = self.rows.take(slot, axis=0)
            left = (now[:, 0] != rows[:, 0]) | (now[:, 1] != rows[:, 1])
            rows, slot = rows[left], (slot[left] + 1) & ((1 << self.bits) - 1)


def digest(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = (low * _U(0x9E3779B97F4A7C15)) ^ (high * _U(0xC2B2AE3D27D4EB4F))
    return (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
