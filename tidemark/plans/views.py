"""Readable views of the stored tables, and records for other systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import text
from tidemark.operators.details import first_value

#: Columns that hold milliseconds, and names that rows hold as ids of dictionaries.
TIMES = ("update_time", "first_seen", "status_change", "last_seen")
DICTIONARIES = ("event_group", "event_class", "event_class_key", "event_key", "monitor", "agent")
REQUIRED_DICTIONARIES = ("event_class",)


def readable(events: DataFrame, dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """Events with uuids, hashes and times as text and names in the place of ids.

    Dictionaries are (id, name); a row without its event class is left out, other names are null where they are missing. The sizes
    of dictionaries are left to the optimiser, which broadcasts the small ones.
    """
    out = events
    for name, table in (dictionaries or {}).items():
        names = table.select(F.col("id").alias(f"{name}_id"), F.col("name").alias(name))
        out = out.join(names, f"{name}_id", "inner" if name in REQUIRED_DICTIONARIES else "left").drop(f"{name}_id")
    shown: list[Column] = []
    for f in out.schema:
        c = F.col(f.name)
        if f.dataType.typeName() == "binary":
            c = F.when(F.octet_length(c) == 16, text.uuid_text(c)).otherwise(text.sha1_text(c))
        elif f.name in TIMES:
            c = text.millis_text(c)
        shown.append(c.alias(f.name))
    return out.select(*shown)


def _column(events: DataFrame, name: str) -> Column:
    return F.col(name) if name in events.columns else F.lit(None).cast("string")


def _detail(events: DataFrame, name: str) -> Column:
    return first_value(F.col("details"), name) if "details" in events.columns else F.lit(None).cast("string")


def _named(names: tuple[str, ...], c: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), c)


ZERO = "0"


def etl_record(events: DataFrame, origin: str, detail_names: tuple[str, ...] = ()) -> DataFrame:
    """The 27 columns of the warehouse's record, all text, and one for each named detail. Carriage returns go; names are in lower case."""
    col = lambda name: _column(events, name)
    plain = lambda c: F.regexp_replace(c, "\r", "")
    number = lambda name: F.coalesce(col(name).cast("string"), F.lit(ZERO))
    words = lambda name: F.coalesce(col(name), F.lit(""))
    return events.select(
        _detail(events, "analytics.instance_key").alias("instance_key"), F.lit(origin).alias("event_source_table"),
        plain(words("fingerprint")).alias("dedupid"), F.col("uuid").alias("evid"),
        words("element_identifier").alias("device"), words("element_sub_identifier").alias("component"),
        words("event_class").alias("event_class"), words("event_key").alias("event_key"),
        F.trim(plain(words("summary"))).alias("summary"), plain(words("message")).alias("message"),
        F.col("severity").cast("string").alias("severity"), F.lower(_named(model.SEVERITY_NAMES, F.col("severity"))).alias("severity_name"),
        F.col("status").cast("string").alias("event_state"), F.lower(_named(model.STATUS_NAMES, F.col("status"))).alias("event_state_name"),
        words("event_class_key").alias("event_class_key"), words("event_group").alias("event_group"),
        number("first_seen").alias("first_time"), number("last_seen").alias("last_time"), number("event_count").alias("count"),
        _detail(events, "production_state").alias("prod_state"), words("agent").alias("agent"), words("monitor").alias("monitor"),
        _detail(events, "analytics.entity_key").alias("entity_key"),
        _detail(events, "analytics.entity_class_name").alias("entity_class_name"), words("cleared_by").alias("clear_evid"),
        number("status_change").alias("state_change"),
        words("element_uuid").alias("element_uuid"), *(_detail(events, d).alias(f"detail_{d}") for d in detail_names),
    )


def etl(summaries: DataFrame, archive: DataFrame, detail_names: tuple[str, ...] = ()) -> DataFrame:
    """Records of all summaries (status) and of the archived events that are none of them (history)."""
    old = archive.join(summaries.select("uuid"), "uuid", "left_anti")
    return etl_record(summaries, "status", detail_names).unionByName(etl_record(old, "history", detail_names))


def short(c: Column, n: int) -> Column:
    """A text of more than n bytes keeps n characters."""
    return F.when(F.octet_length(c) > n, F.substring(c, 1, n)).otherwise(c)


#: Metadata of exported records and the columns that they come from.
METADATA = {
    "monitor": "monitor", "agent": "agent", "event_key": "event_key", "event_class": "event_class", "event_class_key": "event_class_key",
    "event_group": "event_group", "count": "event_count", "first_seen": "first_seen", "last_seen": "last_seen",
    "update_time": "update_time", "cleared_by": "cleared_by",
}
DETAIL_PREFIX = "detail."


def export_record(
    events: DataFrame, tenant: str, source: str, min_severity: int = model.DEBUG, field_bytes: int = 4096, max_bytes: int = 1 << 20
) -> DataFrame:
    """Records for publication, of events of a severity or more, with metadata as lists of values.

    Valid are events with a uuid, a time, a severity, a fingerprint and the uuid of an element. The context is the sub-element where that has a
    uuid, else all of the element. A clear is closed whatever its status, and so is a dropped event; new and acknowledged
    events say which they are. The time is the last update's, else the last occurrence's. Long fields are cut, details without a value are
    left out, and so are records that reach max_bytes as JSON.
    """
    col = lambda name: _column(events, name)
    filled = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    has_sub = filled(col("element_sub_uuid"))
    either = lambda sub, top: F.when(has_sub, col(sub)).otherwise(col(top))
    closed = F.col("status").isin(*model.CLOSED_STATUSES, model.DROPPED) | (F.col("severity") == model.CLEAR)
    status = F.when(closed, "CLOSED").when(F.col("status") == model.SUPPRESSED, "SUPPRESSED").otherwise("OPEN")
    acknowledged = F.when(F.col("status") == model.ACKNOWLEDGED, True).when(F.col("status") == model.NEW, False)
    severity = F.when(F.col("severity") == model.CLEAR, "DEFAULT").otherwise(_named(model.SEVERITY_NAMES, F.col("severity")))
    updated = F.coalesce(F.when(col("update_time").cast("long") > 0, col("update_time").cast("long")), F.col("last_seen"))
    context = {
        "parent_uuid": col("element_uuid"), "parent_id": col("element_identifier"),
        "parent_title": short(col("element_title"), field_bytes),
        "parent_type": col("element_type"), "context_uuid": either("element_sub_uuid", "element_uuid"),
        "context_id": either("element_sub_identifier", "element_identifier"),
        "context_title": short(either("element_sub_title", "element_title"), field_bytes),
        "context_type": either("element_sub_type", "element_type"),
        "status": _named(model.STATUS_NAMES, F.col("status")), "message": short(col("message"), field_bytes),
        **{k: col(c) for k, c in METADATA.items()},
    }
    entry = lambda k, values: F.struct(k.alias("key"), values.alias("value"))
    plain = F.array(
        *(F.when(filled(v) & (v.cast("string") != "0"), entry(F.lit(k), F.array(v.cast("string")))) for k, v in context.items())
    )
    entries = F.array_compact(plain)
    if "details" in events.columns:
        kept = F.filter(
            F.coalesce("details", F.expr("cast(array() as array<struct<name:string,values:array<string>,merge:string>>)")),
            lambda d: F.size(d["values"]) > 0
        )
        cut = lambda v: F.when(F.octet_length(v[0]) > field_bytes, F.array(F.substring(v[0], 1, field_bytes))).otherwise(v)
        entries = F.concat(entries, F.transform(kept, lambda d: entry(F.concat(F.lit(DETAIL_PREFIX), d["name"]), cut(d["values"]))))
    valid = filled(F.col("uuid")) & (F.col("last_seen") > 0) & filled(F.col("fingerprint")) & filled(
        either("element_sub_uuid", "element_uuid")
    )
    out = events.where((F.col("severity") >= min_severity) & valid).select(
        F.lit(tenant).alias("tenant"), F.lit(source).alias("source"), "uuid", "fingerprint", updated.alias("timestamp"),
        status.alias("status"),
        acknowledged.alias("acknowledged"), severity.alias("severity"), short(col("summary"), field_bytes).alias("summary"),
        short(col("message"), field_bytes).alias("body"), col("event_class_key").alias("type"),
        F.map_from_entries(entries).alias("metadata"),
    )
    return out.where(F.octet_length(F.to_json(F.struct("*"))) < max_bytes)
