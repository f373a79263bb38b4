"""Token-ID files: each document compressed by itself under one shared zstandard dictionary.

A file holds up to `FILE_BYTES` of ids. Its parts, all little-endian:

    8 bytes   magic "TMKTOK01"
    8 bytes   dictionary hash (first 8 bytes of its SHA-256)
    4 bytes   bytes of one id (2 or 4)
    4 bytes   number of documents n
    8n bytes  doc_ids (the least long for null)
    4n bytes  tokens of each document
    8(n + 1)  offset index: where each document's frame begins, counted from the first frame
    rest      one zstandard frame for each document

So one document is read by its two offsets and one small frame. The dictionary is trained on the
serialized ids of a bounded sample of documents (`Format.sample`); it only affects size.
Files are kept as rows (part, file, start, content) of a table in the shared folder, which any store that Spark
reads can hold, in ascending doc_id order; ties are ordered by text.

Defined results: a null or empty text has the end id alone. A null doc_id comes first. Repeated
rows are separate documents. An empty table has no files. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import encoder, frames

MAGIC = b"TMKTOK01"
FILE_BYTES = 4 << 20
NO_ID = -(2**63)


@dataclass(frozen=True)
class Format:
    end_id: int
    sample: int = 2000  # documents, at most, that the dictionary is trained on
    sample_chars: int = 8_000_000  # and their characters, at most
    dictionary_bytes: int = 64 << 10
    level: int = 3


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


def _compressor(dictionary: bytes, level: int):
    import zstandard as z

    kw = {"dict_data": z.ZstdCompressionDict(dictionary)} if dictionary else {}
    return z.ZstdCompressor(level=level, write_content_size=True, write_checksum=False, **kw)


def pack_file(doc_ids: list[int | None], arrays: list[bytes], width: int, dictionary: bytes, level: int = 3) -> bytes:
    """One file from the documents' ids (little-endian, `width` bytes each)."""
    c = _compressor(dictionary, level)
    out = [c.compress(a) for a in arrays]
    offsets = np.zeros(len(out) + 1, dtype="<i8")
    np.cumsum([len(f) for f in out], out=offsets[1:])
    head = MAGIC + dictionary_hash(dictionary) + struct.pack("<II", width, len(out))
    ids = np.array([NO_ID if i is None else i for i in doc_ids], dtype="<i8").tobytes()
    return b"".join([head, ids, np.array([len(a) // width for a in arrays], dtype="<u4").tobytes(), offsets.tobytes(), *out])


class TokenFile:
    """Reads one file; the dictionary must be the one that it was written with."""

    def __init__(self, content: bytes, dictionary: bytes):
        if content[:8] != MAGIC or content[8:16] != dictionary_hash(dictionary):
            raise ValueError("not a token file of this dictionary")
        import zstandard as z

        self.width, n = struct.unpack_from("<II", content, 16)
        self.doc_ids = np.frombuffer(content, "<i8", n, 24)
        self.counts = np.frombuffer(content, "<u4", n, 24 + 8 * n)
        self.offsets = np.frombuffer(content, "<i8", n + 1, 24 + 12 * n)
        self.frames = memoryview(content)[24 + 12 * n + 8 * (n + 1) :]
        kw = {"dict_data": z.ZstdCompressionDict(dictionary)} if dictionary else {}
        self._d = z.ZstdDecompressor(**kw)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def find(self, doc_id: int | None) -> range:
        """The places of a document's id; several where rows repeat."""
        key = NO_ID if doc_id is None else doc_id
        return range(int(np.searchsorted(self.doc_ids, key)), int(np.searchsorted(self.doc_ids, key, side="right")))

    def ids(self, i: int) -> np.ndarray:
        frame = self.frames[self.offsets[i] : self.offsets[i + 1]]
        return np.frombuffer(self._d.decompress(frame), dtype=f"<u{self.width}")


def train_dictionary(docs: DataFrame, spec: str, fmt: Format) -> bytes:
    """A dictionary from the ids of at most fmt.sample documents, those with the least hashes of doc_id; none where they are too few."""
    import zstandard as z

    cut = max(1, fmt.sample_chars // fmt.sample)
    share = min(1.0, fmt.sample / max(1, docs.count()))
    h = F.xxhash64("doc_id")
    near = docs.where(h <= int(-(2**63) + min(1.0, 1.2 * share) * (2**64 - 1))) if share < 0.8 else docs
    rows = near.select(h.alias("h"), F.substring("text", 1, cut).alias("t")).orderBy("h", "t").limit(fmt.sample).collect()
    width = "<u2" if encoder.vocab_size(spec) <= 1 << 16 else "<u4"
    arrays = [np.frombuffer(x, "<u4").astype(width).tobytes() for x in encoder.Encoder(spec).encode([r["t"] for r in rows])]
    arrays = [a for a in arrays if len(a) >= 8]
    try:
        return z.train_dictionary(min(fmt.dictionary_bytes, max(1024, sum(map(len, arrays)) // 16)), arrays).as_bytes()
    except (z.ZstdError, ValueError):
        return b""


FILES = "part long, file long, start long, n_docs long, n_tokens long, first_id long, last_id long, content binary"


def write(docs: DataFrame, tokenizer_path: str, fmt: Format) -> tuple[frames.Saved, bytes]:
    """The files of all documents, as a saved table (part, file, start within the part, n_docs, n_tokens, first_id, last_id, content), and their dictionary."""
    spark = docs.sparkSession
    spec = encoder.read_spec(tokenizer_path)
    width = 2 if max(encoder.vocab_size(spec), fmt.end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, spec, fmt)
    shipped, level = frames.Shipped(spark, (spec, dictionary)), fmt.level
    end = np.array([fmt.end_id], dtype=f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, dictionary = shipped.value
        enc, part = encoder.encoder(spec), TaskContext.get().partitionId()
        held: list = []
        state = {"file": 0, "start": 0, "bytes": 0}

        def flush() -> pa.RecordBatch:
            n = state["bytes"] // width
            first, last = (NO_ID if held[k][0] is None else held[k][0] for k in (0, -1))
            row = [
                part, state["file"], state["start"], len(held), n, first, last,
                pack_file([h[0] for h in held], [h[1] for h in held], width, dictionary, level)
            ]
            state.update(file=state["file"] + 1, start=state["start"] + n, bytes=0)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in row[:7]), pa.array([row[7]], pa.binary())],
                names=[c.split()[0] for c in FILES.split(", ")]
            )

        for rb in batches:
            for at in range(0, rb.num_rows, 256):
                piece = rb.slice(at, 256)
                for doc, ids in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist()), strict=True):
                    ids = (np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() if width == 2 else ids) + end
                    held.append((doc, ids))
                    state["bytes"] += len(ids)
                    if state["bytes"] >= FILE_BYTES:
                        yield flush()
        if held:
            yield flush()

    # rows of one id, nulls above all, are many partitions: the first characters of their texts part them in the order of the sort
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    files = frames.Saved(ordered.mapInArrow(run, FILES))
    return files, dictionary


def part_starts(files: DataFrame) -> dict[int, int]:
    """Ids before each part; one row for each partition of the writer reaches the driver."""
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    out, at = {}, 0
    for p in sorted(totals):
        out[p], at = at, at + totals[p]
    return out


def read(files: DataFrame, dictionary: bytes) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), ids as little-endian unsigned 32-bit integers."""
    shipped = frames.Shipped(files.sparkSession, (part_starts(files), dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, dictionary = shipped.value
        for rb in batches:
            for part, start, content in zip(*(rb.column(k).to_pylist() for k in range(3)), strict=True):
                f = TokenFile(content, dictionary)
                begin = starts[part] + start + np.concatenate(([0], np.cumsum(f.counts, dtype=np.int64)))[:-1]
                ids = [f.ids(i).astype("<u4").tobytes() for i in range(len(f))]
                docs = pa.array([None if i == NO_ID else i for i in f.doc_ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([docs, pa.array(begin), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return files.select("part", "start", "content").mapInArrow(run, "doc_id long, start long, ids binary")


def fetch(files: DataFrame, dictionary: bytes, doc_ids: list[int | None]) -> DataFrame:
    """doc_id and ids of a few documents: only the files that can hold them are read, and in these only their frames."""
    keys = sorted({NO_ID if i is None else i for i in doc_ids})
    wanted = F.lit(False)
    for k in keys:
        wanted = wanted | ((F.col("first_id") <= k) & (F.col("last_id") >= k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for content in rb.column(0).to_pylist():
                f = TokenFile(content, dictionary)
                at = [(k, i) for k in keys for i in f.find(k)]
                docs = pa.array([None if k == NO_ID else k for k, _ in at], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array([f.ids(i).astype("<u4").tobytes() for _, i in at], pa.binary())], names=["doc_id", "ids"]
                )

    return files.where(wanted).select("content").mapInArrow(run, "doc_id long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = frames.pick(frames.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    files, dictionary = write(docs, public_tokenizers.path("word_bpe_49k.json"), Format(end_id=2))
    back = read(files.df, dictionary)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
