"""Suffix arrays of byte texts in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search.

A shard is one text of symbols, in which several texts follow each other; symbol 0 stands after each and nowhere else, so a
prefix without a 0 lies inside one text. Places and ranks are 32-bit.
"""

from __future__ import annotations

import numpy as np

MAX_BYTES = 1 << 20
_U = np.uint64


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of `text` in the order of their suffixes, exact to `depth` symbols or more.

    Larsson and Sadakane: suffixes start in groups of one short prefix; a group is refined by the group numbers
    of its suffixes' continuations, which doubles the sorted length; sorted groups are left alone.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int32)
    place = max(1, int(n).bit_length())  # bits of a place
    if place > 31:
        raise ValueError("too much text for one shard")
    bits = max(1, int(text.max()).bit_length())
    h = max(1, (64 - place) // bits)
    key = np.zeros(n, dtype=_U)
    for k in range(h):
        key <<= _U(bits)
        key[: max(0, n - k)] |= text[k:]
    key <<= _U(place)
    key |= np.arange(n, dtype=_U)
    key.sort()
    sa = (key & _U((1 << place) - 1)).astype(np.int32)
    key >>= _U(place)
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    del key
    number = np.zeros(n + 1, dtype=np.int32)  # a group's number is one more than its first place; 0 stands past the end
    number[sa] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1, dtype=np.int32), 0))
    active = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    while h < depth and len(active):
        s = sa[active]
        low = max(1, int(len(active)).bit_length())
        group, follow = number[s].astype(_U), number[np.minimum(s + np.int64(h), n)].astype(_U)
        if place + 1 + low <= 63 - place:
            own = (group << _U(place + 1 + low)) | (follow << _U(low)) | np.arange(len(s), dtype=_U)
            own.sort()
            at = (own & _U((1 << low) - 1)).astype(np.int32)
            own >>= _U(low)
        else:
            at = np.lexsort((follow, group))
            own = (group[at] << _U(place + 1)) | follow[at]
        s = s[at]
        sa[active] = s
        new = np.ones(len(s), dtype=bool)
        new[1:] = own[1:] != own[:-1]
        number[s] = np.maximum.accumulate(np.where(new, active + 1, 0))
        active = active[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def words(text: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on, as one integer, the first lowest; past the end there is 255, which is no symbol."""
    n = len(text)
    t = np.concatenate((text, np.full(8, 255, text.dtype)))
    out = t[:n].astype(_U)
    for k in range(1, 8):
        out |= t[k : n + k].astype(_U) << _U(8 * k)
    return out


def extend(w: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The common prefix of the suffixes i and j, of which k symbols are known to agree, up to `most`."""
    k = k.copy()
    last = len(w) - 1
    go = np.flatnonzero(k < most)
    while len(go):
        a, b = i[go] + k[go], j[go] + k[go]
        x = w[np.minimum(a, last)] ^ w[np.minimum(b, last)]
        x[(a > last) | (b > last)] = 1
        same = np.full(len(go), 8, dtype=np.int32)
        odd = np.flatnonzero(x)
        low = x[odd] & (~x[odd] + _U(1))  # the lowest bit that differs
        same[odd] = np.frexp(low.astype(np.float64))[1] - 1 >> 3
        k[go] = np.minimum(k[go] + same, most[go])
        go = go[(same == 8) & (k[go] < most[go])]
    return k


def kasai(text: np.ndarray, sa: np.ndarray, most: int, stride: int = 64) -> np.ndarray:
    """For each place the common prefix of its suffix with the one before it in `sa`, up to `most`.

    By Kasai's rule a prefix shrinks by at most one symbol from a place to the next. It is used in both
    directions and in strides: places at every 64th symbol are compared first; between two known places the
    rule bounds the prefix from below and above, and only where these bounds differ are symbols compared, from the lower one on.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    w = words(text)
    out = np.zeros(n + stride, dtype=np.int32)  # past the end nothing agrees
    step = stride
    at = np.arange(0, n, step)
    low, high = np.zeros(len(at), np.int32), np.full(len(at), most, np.int32)
    while True:
        j = before[at]
        low, high = np.where(j >= 0, low, 0), np.where(j >= 0, high, 0)
        todo = np.flatnonzero(low < high)
        low[todo] = extend(w, at[todo], j[todo], low[todo], high[todo])
        out[at] = low
        if step == 1:
            return out[:n]
        step //= 2
        at = np.arange(step, n, 2 * step)
        after = out[at + step]
        low = np.maximum(out[at - step] - step, 0)
        high = np.where(after < most, np.minimum(after + step, most), most)
        high = np.maximum(low, high)


def find(mine: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of `size` symbols of text `mine` at `at` equals one of the text `other` at `there`.

    Binary search; `there` are places in the order of their suffixes, and both texts have the same symbols.
    """
    found = np.zeros(len(at), dtype=bool)
    if not len(there) or not len(at):
        return found
    both = np.concatenate((mine, other))
    w, shift = words(both), len(mine)
    low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(there), dtype=np.int64)
    while (open_ := np.flatnonzero((low < high) & ~found)).size:
        mid = (low[open_] + high[open_]) // 2
        i, j = at[open_], there[mid] + shift
        k = extend(w, i, j, np.zeros(len(i), np.int32), np.full(len(i), size, np.int32))
        equal = k == size
        found[open_[equal]] = True
        right = ~equal & (both[np.minimum(i + k, len(both) - 1)] > both[np.minimum(j + k, len(both) - 1)])
        low[open_[right]] = mid[right] + 1
        left = ~equal & ~right
        high[open_[left]] = mid[left]
    return found
