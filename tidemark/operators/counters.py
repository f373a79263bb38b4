"""What became of a batch of occurrences, as counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import state


def of_batch(raw: DataFrame, dropped_clears: DataFrame | None = None) -> DataFrame:
    """(processed, dropped, deduped): valid occurrences, rejected ones and clears that ended nothing, and those that met an earlier one of their key."""
    ok = state.validate(raw)
    key = state.occurrence_hash(F.col("fingerprint"), F.col("status"), F.col("severity"), F.col("created"))
    counts = ok.agg(F.count("*").alias("processed"), F.count_distinct(key).alias("keys"))
    counts = counts.unionByName(state.rejected(raw).agg(F.count("*").alias("dropped")), allowMissingColumns=True)
    if dropped_clears is not None:
        counts = counts.unionByName(dropped_clears.agg(F.count("*").alias("dropped")), allowMissingColumns=True)
    all_ = counts.agg(*(F.sum(c).alias(c) for c in ("processed", "keys", "dropped")))
    return all_.select("processed", "dropped", (F.col("processed") - F.col("keys")).alias("deduped"))


def of_summaries(before: DataFrame, after: DataFrame) -> DataFrame:
    """(cleared, aged, archived): summaries that changed to cleared or aged, and those that are no longer there."""
    both = before.select("uuid", F.col("status").alias("was")).join(after.select("uuid", F.col("status").alias("now")), "uuid", "left")
    became = lambda s: F.count_if((F.col("was") != s) & (F.col("now") == s))
    return both.agg(
        became(model.CLEARED).alias("cleared"), became(model.AGED).alias("aged"), F.count_if(F.col("now").isNull()).alias("archived")
    )
