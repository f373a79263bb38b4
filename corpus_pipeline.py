"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns
of `documents`. Between stages the rows are written as Parquet and read again.

Defined results: null and empty texts have no words and go in the first stage. Rows that repeat are near duplicates, of which one stays;
so do rows of one doc_id with different texts if they are no near duplicates, and rows without an id, whose groups keep the row with the least text key. Of rows
alike in id and text the least by all columns stays. Columns other than those of `documents` are dropped at the first stage, whatever their names. An empty
table gives an empty result. Very long texts are worked through whole, with the memory that the operators name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, frames, near_dedup, packing, quality_rules, substring_dedup

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
DDL = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.judge(frames.pick(docs, **COLUMNS), keep=DDL)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_one(frames.pick(docs, **COLUMNS), near_dedup.Options(), tuple(COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that an earlier document has go from the text; a text that loses nothing stays as it is."""
    out = substring_dedup.strip(frames.pick(docs, **COLUMNS), columns=tuple(COLUMNS), normalise=False)
    length = F.when(F.size("removed_starts") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go."""
    items = frames.pick(frames.table(spark, sf_dir, "benchmark"), item_id="string", text="string")
    return decontamination.clean(frames.pick(docs, **COLUMNS), items, columns=tuple(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed 1024-token sequences, mixed over the sources in proportion to their tokens."""
    import public_tokenizers

    pieces = packing.pack(frames.pick(docs, **COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), packing.Options(end_id=0))
    return packing.digest(pieces)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the first stage's distances nor the last one's tokens. The tests compare run() with plain stages on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = frames.Saved(stage(spark, docs, sf_dir), spark).df
    return STAGES[-1][1](spark, docs, sf_dir)
