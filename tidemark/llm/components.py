"""Connected components by minimum labels with pointer jumping, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames


def components(edges: DataFrame) -> DataFrame:
    """(nid, label) for every end of an edge (a, b) of longs; label is the least of its component.

    Each round takes the least label among a node and its neighbours and then the label of that
    label, so rounds grow with the logarithm of the longest path. Each round is written
    to the shared folder. Labels are aggregated before they are shuffled, so a node with very many neighbours
    is no burden.
    """
    both = frames.Saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = frames.Saved(
        both.df.groupBy(F.col("a").alias("nid")).agg(F.min("b").alias("label")).select("nid", F.least("nid", "label").alias("label"))
    )
    while True:
        old = labels.df
        near = frames.join(
            both.df, old.withColumnRenamed("nid", "b"), ["b"]
        ).groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("near"))
        least = frames.join(old, near, ["nid"]).select("nid", "label", F.least("label", "near").alias("next"))
        jump = old.select(F.col("nid").alias("next"), F.col("label").alias("jump"))
        to = F.least("next", F.coalesce("jump", "next"))
        new = frames.Saved(
            frames.join(least, jump, ["next"], "left").select("nid", to.alias("label"), (to < F.col("label")).alias("moved"))
        )
        moved = new.df.where("moved").limit(1).count()
        labels.drop()
        labels = new
        if not moved:
            both.drop()
            return new.df.select("nid", "label")
