"""Lookups of summaries by uuid and by key, over the summary table and the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_uuid(table: DataFrame, uuid: str) -> DataFrame:
    """One event; the condition reaches the scan."""
    return table.where(F.col("uuid") == uuid).limit(1)


def by_uuids(table: DataFrame, uuids: list[str] | DataFrame) -> DataFrame:
    """The events of a list of uuids, or of a table of them."""
    return table.where(F.col("uuid").isin(*uuids)) if isinstance(uuids, list) else table.join(uuids.select("uuid"), "uuid", "left_semi")


def by_key(archive: DataFrame, keys: DataFrame) -> DataFrame:
    """Archived events by (uuid, last_seen); the day of last_seen prunes the archive's partitions."""
    wanted = keys.select("uuid", "last_seen")
    if "archive_day" not in archive.columns:
        return archive.join(wanted, ["uuid", "last_seen"], "left_semi")
    return archive.join(
        wanted.withColumn("archive_day", F.expr("last_seen div 86400000")), ["archive_day", "uuid", "last_seen"], "left_semi"
    )


def with_fallback(summaries: DataFrame, archive: DataFrame, uuids: DataFrame) -> DataFrame:
    """Events by uuid from the summaries, and from the archive where the summaries have none."""
    found = by_uuids(summaries, uuids)
    rest = uuids.select("uuid").join(found.select("uuid"), "uuid", "left_anti")
    return found.unionByName(by_uuids(archive.select(*summaries.columns), rest))


def in_order_of(hits: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of a table for a list of hits (uuid, ordinal), in the hits' order; hits without a row are left out."""
    return hits.join(table, "uuid").orderBy("ordinal")


def partition_page(archive: DataFrame, after: tuple[int, str] | None, max_update: int, n: int) -> DataFrame:
    """A page of the archive, newest day first and by uuid inside a day; after is the last row's (day, uuid) of the page before."""
    rows = archive.where(F.col("update_time") <= max_update)
    if after is not None:
        day, uuid = after
        rows = rows.where((F.col("archive_day") < day) | (F.col("archive_day") == day) & (F.col("uuid") > uuid))
    return rows.orderBy(F.desc("archive_day"), "uuid").limit(n)


def time_since(times: DataFrame, since_ms: int, n: int = 1000) -> DataFrame:
    """The event-time log from a moment on, oldest first."""
    return times.where(F.col("processed") >= since_ms).orderBy("processed", "uuid").limit(n)


def changed(queue: DataFrame, archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to index, keys whose row is gone) of a change queue (uuid, last_seen), each key once."""
    keys = queue.select("uuid", "last_seen").distinct()
    return archive.join(keys, ["uuid", "last_seen"], "left_semi"), keys.join(archive, ["uuid", "last_seen"], "left_anti")


def encode(names: DataFrame, column: str, stored: DataFrame) -> DataFrame:
    """A dictionary (id, name) with the names that it lacks added after its last id, in their order.

    New names are numbered by their order within ranges and the sizes of the ranges before, so no task sees all of them.
    """
    new = names.select(F.col(column).alias("name")).where("name is not null").distinct().join(stored.select("name"), "name", "left_anti")
    ranged = new.withColumn("prefix", F.substring(F.sha1("name"), 1, 3))
    last = stored.agg(F.lit("").alias("prefix"), F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("n"))  # the numbers that are taken
    sizes = ranged.groupBy("prefix").agg(F.count("*").alias("n")).unionByName(last)  # at most 4097 rows
    earlier = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("prefix", F.sum("n").over(earlier).alias("before"))
    local = F.row_number().over(Window.partitionBy("prefix").orderBy("name"))
    out = ranged.withColumn("k", local).join(before, "prefix")
    return stored.select("id", "name").unionByName(out.select((F.col("before") + F.col("k")).cast("long").alias("id"), "name"))


def apply_changes(index: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """A table of one row for each uuid after rows were written and deleted."""
    touched = upserts.select("uuid").union(deletes.select("uuid")).distinct()
    return index.join(touched, "uuid", "left_anti").unionByName(
        upserts.join(deletes.select("uuid"), "uuid", "left_anti").select(*index.columns)
    )


def purge(table: DataFrame, threshold_ms: int, column: str = "last_seen") -> DataFrame:
    """Rows later than the threshold."""
    return table.where(F.col(column) > threshold_ms)
