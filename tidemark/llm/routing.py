"""Packed lookups by digest across all documents.

Batches of documents send digests of word windows to buckets; a bucket sees every occurrence of its digests and
answers the batches that asked. Rows carry packed arrays, a few bytes for each entry, since a row for each window
would be many times the size of the text. A batch sends a digest that several of its documents
share only once, so a digest that a third of all documents hold costs its bucket one entry for each
batch, never one for each document. The number of buckets grows with the text.

Up to `FAN` buckets a batch sends each of them a row. Beyond that rows go in two hops: a batch sends a row to each coarse bucket, of which there are
about the root of all; there the rows of a region, which is `REGION` batches of one task, are joined and dealt to the fine buckets. Answers go to
regions, too. So a batch sends about the root of the number of buckets, and a region one row to each bucket that it has something for.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20

#: Rows that a batch sends at most before rows go in two hops, and the batches of a region (a power of two).
FAN = 4096
REGION = 64

SENT = "bucket long, batch long, payload binary"
REPLY = "batch long, payload binary"


def buckets_for(n_bytes: int) -> int:
    return max(1, -(-n_bytes // BUCKET_BYTES))


def fine(n: int) -> int:
    """How many buckets a coarse one has."""
    return max(1, int(np.ceil(np.sqrt(n))))


def shift(n: int) -> int:
    """Batch numbers without their last bits are regions; in one hop a region is a batch."""
    return 0 if n <= FAN else REGION.bit_length() - 1


def bucket_of(digest: np.ndarray, n: int) -> np.ndarray:
    """By the digest's upper half, which leaves its lower half to tell digests of a bucket apart."""
    return (((digest >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def squeeze(a: np.ndarray) -> bytes:
    """An array as zstandard-compressed byte planes (the upper bytes of small numbers vanish)."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def places(flat: np.ndarray) -> np.ndarray:
    """Sorted places as differences."""
    return np.diff(flat, prepend=0).astype(np.uint32)


def join(*parts: bytes) -> bytes:
    return struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def split(b: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", b)
    sizes = struct.unpack_from(f"<{n}I", b, 4)
    out, at = [], 4 + 4 * n
    for s in sizes:
        out.append(b[at : at + s])
        at += s
    return out


def _columns(columns: list[np.ndarray], kinds: str) -> list[bytes]:
    """Columns as bytes: kind `d` are digests, which no compression makes smaller."""
    return [np.ascontiguousarray(c).tobytes() if k == "d" else squeeze(c) for c, k in zip(columns, kinds, strict=True)]


def _slices(own: np.ndarray):
    """(value, begin, end) of each run of a sorted array."""
    if len(own):
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        yield from zip(own[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True)


def outgoing(number: int, bucket: np.ndarray, at: np.ndarray, columns: list[np.ndarray], kinds: str, n: int) -> list[tuple]:
    """The rows (bucket, batch, payload) that a batch sends for entries of the given buckets and places."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    own, at, columns = bucket[order], at[order], [c[order] for c in columns]
    if n <= FAN:
        return [(k, number, join(b"E", squeeze(places(at[i:j])), *_columns([c[i:j] for c in columns], kinds))) for k, i, j in _slices(own)]
    f, out = fine(n), []
    for k, i, j in _slices(own // f):
        parts = _columns([c[i:j] for c in columns], kinds)
        out.append((k, number, join(b"C", squeeze((own[i:j] - k * f).astype(np.uint32)), squeeze(at[i:j].astype(np.uint32)), *parts)))
    return out


def _read(parts: list[bytes], kinds: str, dtypes: list) -> list[np.ndarray]:
    return [np.frombuffer(p, t) if k == "d" else unsqueeze(p, t) for p, k, t in zip(parts, kinds, dtypes, strict=True)]


def spread(kinds: str, dtypes: list, n: int):
    """The second hop: rows of a coarse bucket and a region become one row for each fine bucket."""
    f = fine(n)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["bucket", "batch", "payload"])
        numbers = table.column("batch").to_numpy()
        parts = [split(p) for p in table.column("payload").to_pylist()]
        of = [unsqueeze(p[1], np.uint32) for p in parts]
        which = np.repeat(np.arange(len(of), dtype=np.uint16), [len(x) for x in of])
        own = np.concatenate(of)
        at = np.concatenate([unsqueeze(p[2], np.uint32) for p in parts])
        columns = [np.concatenate(c) for c in zip(*(_read(p[3:], kinds, dtypes) for p in parts), strict=True)]
        order = np.argsort(own, kind="stable")
        own, which, at, columns = own[order], which[order], at[order], [c[order] for c in columns]
        head, first, rows = numbers.tobytes(), key[0].as_py() * f, []
        for k, i, j in _slices(own.astype(np.int64)):
            rows.append(
                (
                    first + k, key[1].as_py(),
                    join(b"M", head, squeeze(which[i:j]), squeeze(at[i:j]), *_columns([c[i:j] for c in columns], kinds))
                )
            )
        return table_of(rows, SENT)

    return run


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.split(",")]
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.table({n: pa.array(c, pa.binary() if n == "payload" else pa.int64()) for n, c in zip(names, cols, strict=True)})


def entries(table: pa.Table, kinds: str, dtypes: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(batch number, place, columns) of all entries of a bucket's rows."""
    numbers, ats, columns = [], [], []
    for batch, payload in zip(table.column("batch").to_pylist(), table.column("payload").to_pylist(), strict=True):
        p = split(payload)
        if p[0] == b"E":
            at = np.cumsum(unsqueeze(p[1], np.uint32).astype(np.int64))
            numbers.append(np.full(len(at), batch, dtype=np.int64))
            columns.append(_read(p[2:], kinds, dtypes))
        else:
            at = unsqueeze(p[3], np.uint32).astype(np.int64)
            numbers.append(np.frombuffer(p[1], np.int64)[unsqueeze(p[2], np.uint16)])
            columns.append(_read(p[4:], kinds, dtypes))
        ats.append(at)
    return np.concatenate(numbers), np.concatenate(ats), [np.concatenate(c) for c in zip(*columns, strict=True)]


def local(number: int, at: np.ndarray) -> bytes:
    """An answer that a batch gives itself."""
    return join(b"L", struct.pack("<q", number), squeeze(places(at)))


def replies(number: np.ndarray, at: np.ndarray, n: int) -> pa.Table:
    """Answers to regions: the places of entries, by batch."""
    order = np.lexsort((at, number))
    number, at, s = number[order], at[order], shift(n)
    if s == 0:
        rows = [(k, local(k, at[i:j])) for k, i, j in _slices(number)]
    else:
        rows = []
        for k, i, j in _slices(number >> s):
            low = (number[i:j] & (REGION - 1)).astype(np.uint16)
            rows.append((k, join(b"R", struct.pack("<q", k << s), squeeze(low), squeeze(at[i:j].astype(np.uint32)))))
    return table_of(rows, REPLY)


def answers(payloads: list[bytes]) -> tuple[dict[int, list[bytes]], dict[int, np.ndarray]]:
    """A region's headers and the different places that were answered, by batch number."""
    headers, flat = {}, {}
    for payload in payloads:
        p = split(payload)
        (number,) = struct.unpack("<q", p[1])
        if p[0] == b"H":
            headers[number] = p[2:]
        elif p[0] == b"L":
            flat.setdefault(number, []).append(np.cumsum(unsqueeze(p[2], np.uint32).astype(np.int64)))
        else:
            low, at = unsqueeze(p[2], np.uint16), unsqueeze(p[3], np.uint32).astype(np.int64)
            for k in np.unique(low).tolist():
                flat.setdefault(number + k, []).append(at[low == k])
    return headers, {k: np.unique(np.concatenate(v)) for k, v in flat.items()}


def repeated(values: np.ndarray) -> np.ndarray:
    """The values found twice or more, sorted."""
    s = np.sort(values)
    return np.unique(s[1:][s[1:] == s[:-1]])
