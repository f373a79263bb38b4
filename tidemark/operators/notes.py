"""Notes and the audit log of summaries: lists of structs, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import details

NOTES = "array<struct<uuid:string,message:string,user_uuid:string,user_name:string,created_time:bigint>>"
AUDIT = "array<struct<timestamp:bigint,new_status:int,user_uuid:string,user_name:string>>"


def _prepend(new: Column, old: str, kind: str) -> Column:
    return F.concat(
        F.array(new.cast(kind.removeprefix("array<").removesuffix(">"))), F.coalesce(old, F.expr(f"cast(array() as {kind})"))
    ).cast(kind)


def add_note(summaries: DataFrame, uuid: str, message: str, user_uuid: str, user_name: str, now_ms: int) -> DataFrame:
    note_id = F.sha1(F.concat_ws("|", F.lit(uuid), F.lit(message), F.lit(str(now_ms))))
    note = F.struct(
        note_id.alias("uuid"), F.lit(message).alias("message"), F.lit(user_uuid).alias("user_uuid"), F.lit(user_name).alias("user_name"),
        F.lit(now_ms).cast("long").alias("created_time")
    )
    out = summaries.withColumn("notes", F.when(F.col("uuid") == uuid, _prepend(note, "notes", NOTES)).otherwise(F.col("notes")))
    return _touched(out, F.col("uuid") == uuid, now_ms)


def _touched(summaries: DataFrame, rows: Column, now_ms: int) -> DataFrame:
    if "update_time" not in summaries.columns:
        return summaries
    return summaries.withColumn("update_time", F.when(rows, F.lit(now_ms).cast("long")).otherwise(F.col("update_time")))


def update_details(
    summaries: DataFrame, uuid: str, new: Column, now_ms: int, max_bytes: int = 1 << 15, important: tuple[str, ...] = ()
) -> DataFrame:
    """Details merged onto one event's, within the size that details may have."""
    hit = F.col("uuid") == uuid
    out = summaries.withColumn(
        "details",
        F.when(hit, details.merge_within(F.col("details"), new.cast(details.DETAILS), max_bytes, important)).otherwise(F.col("details"))
    )
    return _touched(out, hit, now_ms)


def in_either(change, summaries: DataFrame, archive: DataFrame, uuid: str) -> tuple[DataFrame, DataFrame]:
    """A change of one event, made in the summaries or, where they lack it, in the archive."""
    if summaries.where(F.col("uuid") == uuid).limit(1).count():
        return change(summaries), archive
    return summaries, change(archive)


def audit(summaries: DataFrame, moved: Column, status: int, user_uuid: str | None, user_name: str | None, now_ms: int) -> DataFrame:
    entry = F.struct(
        F.lit(now_ms).cast("long").alias("timestamp"), F.lit(status).alias("new_status"),
        F.lit(user_uuid).cast("string").alias("user_uuid"), F.lit(user_name).cast("string").alias("user_name")
    )
    return summaries.withColumn("audit_log", F.when(moved, _prepend(entry, "audit_log", AUDIT)).otherwise(F.col("audit_log")))
