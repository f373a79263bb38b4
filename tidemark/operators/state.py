"""Event state in batches: de-duplication, clearing, transitions, ageing, archiving, identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.text import clear_fingerprint, truncate_utf8
from tidemark.operators import details as detail_lists

#: Arrivals of one key that are put in order together; a hot key is many blocks and so many tasks.
BLOCK = 1 << 16
DAY_MS = 86_400_000

REQUIRED = ("event_class", "severity", "element_identifier", "element_uuid")
#: Columns of an occurrence that its summary takes over where there are any.
OPTIONAL = (
    "element_title", "element_type", "element_sub_identifier", "element_sub_uuid", "element_sub_title", "element_sub_type",
    "event_key", "event_class_key", "event_group", "agent", "monitor", "summary", "message", "clear_hash", "tags_json",
)


def validate(raw: DataFrame) -> DataFrame:
    """Occurrences without uuid or time and dropped ones go; an empty class becomes /Unknown."""
    ok = (F.coalesce("uuid", F.lit("")) != "") & F.col("created").isNotNull() & (F.col("status") != model.DROPPED)
    return raw.where(ok).withColumn(
        "event_class", F.when(F.coalesce("event_class", F.lit("")) == "", "/Unknown").otherwise(F.col("event_class"))
    )


def rejected(raw: DataFrame) -> DataFrame:
    """What validate drops, with the reason: the dead letters of a batch."""
    reason = F.when(
        F.coalesce("uuid", F.lit("")) == "", "no uuid"
    ).when(F.col("created").isNull(), "no time").when(F.col("status") == model.DROPPED, "dropped")
    return raw.withColumn("reason", reason).where("reason is not null")


def fingerprint_hash(fingerprint: Column) -> Column:
    return F.sha1(truncate_utf8(fingerprint, model.LIMITS["fingerprint"]))


def closed_hash(fingerprint: Column, at_ms: Column) -> Column:
    """The hash of a closed event: each closing time has its own, so closed events stay apart."""
    return F.sha1(F.concat_ws("|", truncate_utf8(fingerprint, model.LIMITS["fingerprint"]), at_ms.cast("string")))


def occurrence_hash(fingerprint: Column, status: Column, severity: Column, created: Column) -> Column:
    """Where an occurrence is stored: closed ones apart by their time (clears one millisecond earlier, so as not to meet what they clear)."""
    salted = closed_hash(fingerprint, created - F.when(severity == model.CLEAR, 1).otherwise(0))
    return F.when(status.isin(*model.CLOSED_STATUSES), salted).otherwise(fingerprint_hash(fingerprint))


def _content(df: DataFrame) -> list[str]:
    return [*REQUIRED, *(c for c in OPTIONAL if c in df.columns)]


def _arrivals(events: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, list[str], list[str]]:
    """Occurrences, and stored summaries as the first arrivals of their keys, in one shape; their keys and content columns."""
    content = _content(events)
    keys = ["hash", *(["life"] if "life" in events.columns else [])]
    has_details = "details" in events.columns
    rows = events.select(
        occurrence_hash(F.col("fingerprint"), F.col("status"), F.col("severity"), F.col("created")).alias("hash"), *keys[1:],
        F.col("arrival_seq").cast("long").alias("seq"), "uuid",
        F.col("count").cast("long").alias("n"), "created", F.col("created").alias("first"), F.col("created").alias("changed"), "status",
        truncate_utf8(F.col("fingerprint"), model.LIMITS["fingerprint"]).alias("fingerprint"),
        *content, *(["details"] if has_details else []),
    )
    if stored is not None:
        changed = F.col("status_change") if "status_change" in stored.columns else F.col("last_seen")
        held = {
            c: (
                F.col(c) if c in stored.columns else F.lit(None).cast(rows.schema[c].dataType)
            ).alias(c) for c in [*keys[1:], *content, *(["details"] if has_details else [])]
        }
        rows = rows.unionByName(
            stored.select(
                F.col("fingerprint_hash").alias("hash"), F.lit(-1).cast("long").alias("seq"), "uuid",
                F.col("event_count").cast("long").alias("n"), F.col("last_seen").alias("created"),
                F.col("first_seen").alias("first"), changed.alias("changed"), "status", "fingerprint", *held.values(),
            )
        )
    return rows, keys, content


def _marked(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Adds block and late: whether an earlier arrival of the key was created after this one.

    The running maximum goes by (key, block); what earlier blocks hold comes from an aggregate of one row for each block.
    """
    rows = rows.withColumn("block", F.expr(f"seq div {block}"))
    tops = rows.groupBy(*keys, "block").agg(F.max("created").alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*keys, "block", F.max("top").over(earlier).alias("before"))
    w = Window.partitionBy(*keys, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.greatest("before", F.max("created").over(w))
    marked = rows.join(before, [*keys, "block"]).withColumn("late", F.coalesce(F.col("created") < top, F.lit(False)))
    return marked.withColumn("was", F.last(F.when(~F.col("late"), F.col("status")), ignorenulls=True).over(w))


def dedup(events: DataFrame, stored: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One summary for each active fingerprint (and life of it where events have a column life), and one for each closed occurrence.

    Counts add up and the earliest time stays. The rest is the latest occurrence's: an occurrence is late if an
    earlier arrival was created after it, and late ones change neither status nor content. An acknowledged
    event stays so under new and suppressed occurrences; status_change is the time of the occurrence that brought the status. Details
    are merged in the order of arrival. Stored summaries come first, so folding batches one by one is the same as folding all
    at once; columns that only they have are kept.
    """
    rows, keys, content = _arrivals(events, stored)
    marked = _marked(rows, keys, block)
    on_time = lambda c: F.when(~F.col("late"), c)
    moved = F.col("was").isNotNull() & (F.col("was") != F.col("status"))
    by_block = marked.groupBy(*keys, "block").agg(
        F.min(F.struct("seq", "uuid")).alias("u"), F.sum("n").alias("n"), F.min("first").alias("first_seen"),
        F.max("created").alias("last_seen"),
        F.max(on_time(F.struct("seq", "status", "fingerprint", *content))).alias("l"),
        F.min(on_time(F.struct("seq", "status", "changed"))).alias("f"),
        F.max(on_time(F.when(moved, F.struct("seq", "changed")))).alias("moved"),
        F.min(on_time(F.when(F.col("status") == model.ACKNOWLEDGED, F.struct("seq", "changed")))).alias("ack"),
    )
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    came = F.last("l.status", ignorenulls=True).over(earlier)
    entered = F.when(
        F.col("f").isNotNull() & ~F.col("f.status").eqNullSafe(came),
        F.struct(F.col("f.seq").alias("seq"), F.col("f.changed").alias("changed"))
    )
    agg = by_block.withColumn("moved", F.coalesce("moved", entered)).groupBy(*keys).agg(
        F.min("u").alias("u"), F.sum("n").alias("event_count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.max("l").alias("l"), F.max("moved").alias("moved"), F.min("ack").alias("ack")
    )
    acked = F.col("ack").isNotNull() & F.col("l.status").isin(model.NEW, model.ACKNOWLEDGED, model.SUPPRESSED)
    out = agg.select(
        F.col("u.uuid").alias("uuid"), F.col("hash").alias("fingerprint_hash"), "l.fingerprint", "l.event_class", "l.severity",
        F.when(acked, model.ACKNOWLEDGED).otherwise(F.col("l.status")).alias("status"),
        "l.element_identifier", "l.element_uuid", "event_count", "first_seen", "last_seen",
        F.when(acked, F.col("ack.changed")).otherwise(F.col("moved.changed")).alias("status_change"),
        *(f"l.{c}" for c in content[len(REQUIRED) :]), *keys[1:],
    )
    if "details" in rows.columns:
        merged = detail_lists.fold(marked, keys).withColumnRenamed("hash", "fingerprint_hash")
        out = out.join(merged, ["fingerprint_hash", *keys[1:]], "left")
    extra = [c for c in stored.columns if c not in out.columns] if stored is not None else []
    return out.join(stored.select("fingerprint_hash", *extra), "fingerprint_hash", "left").select(*out.columns, *extra) if extra else out


def clear_marks(open_events: DataFrame, clears_: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """(uuid, cleared_by): open events (uuid, clear_hash, last_seen) and the first clear (clear_hash, clear_uuid, created) at or after them.

    Both sides go through one ordered pass by key and day; what later days hold comes from an aggregate of one row for each of
    them. No event meets a clear as a pair of rows.
    """
    a = open_events.select("clear_hash", F.col("last_seen").alias("t"), "uuid", F.lit(None).cast("string").alias("clear_uuid"))
    b = clears_.select("clear_hash", F.col("created").alias("t"), F.lit(None).cast("string").alias("uuid"), "clear_uuid")
    rows = a.unionByName(b).where("clear_hash is not null").withColumn("block", F.expr(f"t div {block_ms}"))
    clear = F.when(F.col("clear_uuid").isNotNull(), F.struct("t", "clear_uuid"))
    per = rows.groupBy("clear_hash", "block").agg(F.min(clear).alias("c"))
    later = Window.partitionBy("clear_hash").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = per.select("clear_hash", "block", F.min("c").over(later).alias("after"))
    w = Window.partitionBy("clear_hash", "block").orderBy(
        F.desc("t"), F.col("clear_uuid").desc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("c", F.min(clear).over(w)).where("uuid is not null").join(after, ["clear_hash", "block"])
    return found.select("uuid", F.coalesce("c", "after")["clear_uuid"].alias("cleared_by")).where("cleared_by is not null")


def clear(summaries: DataFrame, clears_: DataFrame, generate=None) -> tuple[DataFrame, DataFrame]:
    """(summaries after a batch of clear occurrences, the clears that ended nothing and are dropped).

    summaries have clear_hash; clears_ have the columns of an occurrence and clear_hashes, or `generate` makes these from
    the frame. Open events that were last seen by a clear become cleared by the first one; a clear that is the first of any is stored
    itself, closed.
    """
    named = clears_ if generate is None else generate(clears_)
    keys = named.select(F.explode(F.array_distinct("clear_hashes")).alias("clear_hash"), F.col("uuid").alias("clear_uuid"), "created")
    marks = clear_marks(
        summaries.where(F.col("status").isin(*model.OPEN_STATUSES)), keys
    ).groupBy("uuid").agg(F.min("cleared_by").alias("by"))
    at = marks.join(named.select(F.col("uuid").alias("by"), F.col("created").alias("at")), "by")
    held = summaries if "cleared_by" in summaries.columns else summaries.withColumn("cleared_by", F.lit(None).cast("string"))
    out = held.join(at, "uuid", "left")
    gone = F.col("by").isNotNull()
    for name, value in (
        ("cleared_by", F.col("by")), ("status", F.lit(model.CLEARED)), ("status_change", F.col("at")),
        ("fingerprint_hash", closed_hash(F.col("fingerprint"), F.col("at")))
    ):
        if name in out.columns:
            out = out.withColumn(name, F.when(gone, value).otherwise(F.col(name)))
    used = at.select(F.col("by").alias("uuid")).distinct()
    closing = named.drop("clear_hashes").withColumn("status", F.lit(model.CLOSED))
    stored = dedup(closing.join(used, "uuid", "left_semi"))
    return out.select(*held.columns).unionByName(
        stored.select(*(c for c in stored.columns if c in held.columns)), allowMissingColumns=True
    ), named.join(used, "uuid", "left_anti")


def clearing_event(summaries: DataFrame) -> DataFrame:
    """Cleared events with the severity and time of the event that cleared them, null where it is gone."""
    by = summaries.select(
        F.col("uuid").alias("cleared_by"), F.col("severity").alias("clear_severity"), F.col("last_seen").alias("clear_time"),
        F.lit(True).alias("clear_found")
    )
    return summaries.where("cleared_by is not null").join(by, "cleared_by", "left")


def apply_clears(summaries: DataFrame, cleared: DataFrame) -> DataFrame:
    out = summaries.join(cleared, "uuid", "left")
    return out.withColumn("status", F.when(F.col("cleared_by").isNotNull(), model.CLEARED).otherwise(F.col("status")))


ALLOWED = {
    model.ACKNOWLEDGED: (model.NEW, model.SUPPRESSED, model.ACKNOWLEDGED),
    model.CLOSED: model.OPEN_STATUSES,
    model.NEW: (*model.CLOSED_STATUSES, model.ACKNOWLEDGED, model.SUPPRESSED),
    model.SUPPRESSED: (model.NEW,),
}


def transition(summaries: DataFrame, uuids: DataFrame, to: int, now_ms: int, user: str | None = None) -> DataFrame:
    """Moves the listed summaries to a status where that is allowed; all others pass unchanged.

    A second acknowledgement by the same user does nothing. Closing salts the fingerprint hash, reopening
    restores it, unless another active event has it by now: then the event stays closed. Who cleared it is forgotten.
    """
    marked = summaries.join(uuids.select("uuid").distinct().withColumn("asked", F.lit(True)), "uuid", "left")
    can = F.coalesce("asked", F.lit(False)) & F.col("status").isin(*ALLOWED[to])
    own = fingerprint_hash(F.col("fingerprint"))
    if to == model.ACKNOWLEDGED:
        can = can & ~((F.col("status") == to) & F.col("user_name").eqNullSafe(F.lit(user)))
    if to == model.NEW:
        # an active event holds the plain hash; of several that would reopen to one hash, the least uuid does
        active = summaries.where(
            ~F.col("status").isin(model.CLOSED, model.CLEARED)
        ).select(own.alias("h"), F.col("uuid").alias("other")).groupBy("h").agg(F.min("other").alias("other"))
        first = marked.where(can).groupBy(own.alias("h")).agg(F.min("uuid").alias("first"))
        marked = marked.withColumn("h", own).join(active, "h", "left").join(first, "h", "left").drop("h")
        can = can & F.when(F.col("other").isNull(), F.col("first") == F.col("uuid")).otherwise(F.col("other") == F.col("uuid"))
    closing = to in model.CLOSED_STATUSES
    user_name = F.lit(user) if to == model.ACKNOWLEDGED else F.col("user_name") if to in (model.CLOSED, model.CLEARED) else F.lit(None).cast("string")
    new_hash = closed_hash(F.col("fingerprint"), F.lit(now_ms)) if closing else own
    out = marked.withColumn("moved", can)
    now = F.lit(now_ms).cast("long")
    for name, value in (
        ("fingerprint_hash", new_hash), ("user_name", user_name), ("status_change", now), ("update_time", now),
        ("cleared_by", F.lit(None).cast("string")), ("status", F.lit(to))
    ):
        if name in summaries.columns:
            out = out.withColumn(name, F.when(F.col("moved"), value).otherwise(F.col(name)))
    return out.select(*summaries.columns)


def age_condition(now_ms: int, interval_ms: int, max_severity: int, inclusive: bool = False) -> Column:
    severity = F.col("severity") <= max_severity if inclusive else F.col("severity").isin(*model.severities_below(max_severity))
    return F.col("status").isin(*model.OPEN_STATUSES) & severity & (F.col("last_seen") < now_ms - interval_ms)


def _first(summaries: DataFrame, cond: Column, limit: int | None) -> DataFrame:
    """Adds `chosen`: the rows of a condition, at most `limit` of them by (last_seen, uuid)."""
    if limit is None:
        return summaries.withColumn("chosen", cond)
    some = summaries.where(cond).orderBy("last_seen", "uuid").limit(limit).select("uuid", F.lit(True).alias("chosen"))
    return summaries.join(some, "uuid", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def age(
    summaries: DataFrame, now_ms: int, interval_ms: int, max_severity: int, inclusive: bool = False, limit: int | None = None
) -> DataFrame:
    """Old open events become aged. Their fingerprint hash stays, so a new occurrence still merges into them."""
    out = _first(summaries, age_condition(now_ms, interval_ms, max_severity, inclusive), limit)
    now = F.lit(now_ms).cast("long")
    for name, value in (("status_change", now), ("update_time", now), ("status", F.lit(model.AGED))):
        if name in summaries.columns:
            out = out.withColumn(name, F.when(F.col("chosen"), value).otherwise(F.col(name)))
    return out.select(*summaries.columns)


def archive_split(summaries: DataFrame, now_ms: int, interval_ms: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(summaries that stay, rows for the archive with their day)."""
    old = F.col("status").isin(*model.CLOSED_STATUSES) & (F.col("last_seen") < now_ms - interval_ms)
    marked = _first(summaries, old, limit)
    return marked.where("not chosen").select(*summaries.columns), marked.where("chosen").select(
        *summaries.columns, F.expr(f"last_seen div {DAY_MS}").alias("archive_day")
    )


def _clear_hash() -> Column:
    return clear_fingerprint(
        F.col("element_identifier"), F.col("element_sub_identifier"), F.col("event_class"), F.col("event_key"), F.col("element_sub_uuid")
    )


def reidentify(summaries: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Model elements that were added: changes are (type, id, uuid, title, parent_uuid).

    Events of an element known by type and identifier only get its uuid and title; sub-elements are found under their parent's uuid, and
    their clear hash is made anew, as it goes by the uuid from then on.
    """
    one = changes.groupBy("type", "id").agg(F.max(F.struct("uuid", "title", "parent_uuid")).alias("x"))
    limit = model.LIMITS["element_title"]
    top = one.select(
        F.col("type").alias("element_type"), F.col("id").alias("element_identifier"), F.col("x.uuid").alias("new_uuid"),
        truncate_utf8(F.col("x.title"), limit).alias("new_title")
    )
    out = summaries.join(top, ["element_type", "element_identifier"], "left")
    hit = F.col("element_uuid").isNull() & F.col("new_uuid").isNotNull()
    out = out.withColumns(
        {
            "element_title": F.when(hit, F.col("new_title")).otherwise(F.col("element_title")),
            "update_time": F.when(hit, F.lit(now_ms).cast("long")).otherwise(F.col("update_time")),
            "element_uuid": F.coalesce("element_uuid", "new_uuid")
        }
    )
    sub = changes.where("parent_uuid is not null").groupBy("type", "id", "parent_uuid").agg(F.max(F.struct("uuid", "title")).alias("x"))
    sub = sub.select(
        F.col("type").alias("element_sub_type"), F.col("id").alias("element_sub_identifier"), F.col("parent_uuid").alias("element_uuid"),
        F.col("x.uuid").alias("sub_uuid"), truncate_utf8(F.col("x.title"), limit).alias("sub_title")
    )
    out = out.select(*summaries.columns).join(sub, ["element_sub_type", "element_sub_identifier", "element_uuid"], "left")
    hit = F.col("element_sub_uuid").isNull() & F.col("sub_uuid").isNotNull()
    out = out.withColumns(
        {
            "element_sub_title": F.when(hit, F.col("sub_title")).otherwise(F.col("element_sub_title")),
            "update_time": F.when(hit, F.lit(now_ms).cast("long")).otherwise(F.col("update_time")), "hit": hit,
            "element_sub_uuid": F.coalesce("element_sub_uuid", "sub_uuid")
        }
    )
    return out.withColumn("clear_hash", F.when(F.col("hit"), _clear_hash()).otherwise(F.col("clear_hash"))).select(*summaries.columns)


def deidentify(summaries: DataFrame, removed: DataFrame, now_ms: int) -> DataFrame:
    """Model elements that were removed (uuid): events lose their uuid; where it was a sub-element's, the clear hash is made anew."""
    gone = removed.select("uuid").distinct()
    out = summaries.join(gone.select(F.col("uuid").alias("element_uuid"), F.lit(True).alias("top")), "element_uuid", "left").join(
        gone.select(F.col("uuid").alias("element_sub_uuid"), F.lit(True).alias("sub")), "element_sub_uuid", "left"
    )
    none = F.lit(None).cast("string")
    out = out.withColumns({
        "element_uuid": F.when(F.col("top"), none).otherwise(F.col("element_uuid")),
        "element_sub_uuid": F.when(F.col("sub"), none).otherwise(F.col("element_sub_uuid")),
        "update_time": F.when(F.coalesce("top", "sub"), F.lit(now_ms).cast("long")).otherwise(F.col("update_time")),
    })
    return out.withColumn("clear_hash", F.when(F.col("sub"), _clear_hash()).otherwise(F.col("clear_hash"))).select(*summaries.columns)


def import_new(summaries: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported summaries whose uuid, or active fingerprint, is not there yet; they say when they were last updated where they came from."""
    fresh = imported.join(summaries.select("uuid"), "uuid", "left_anti")
    active = summaries.where(~F.col("status").isin(model.CLOSED, model.CLEARED)).select("fingerprint_hash")
    fresh = fresh.join(active, "fingerprint_hash", "left_anti")
    if "details" in fresh.columns and "update_time" in fresh.columns:
        mark = F.array(
            F.struct(
                F.lit(model.MIGRATE_DETAIL).alias("name"), F.array(F.col("update_time").cast("string")).alias("values"),
                F.lit("REPLACE").alias("merge")
            )
        ).cast(detail_lists.DETAILS)
        fresh = fresh.withColumn("details", detail_lists.merge(F.col("details"), mark))
    return summaries.unionByName(fresh.select(*summaries.columns))


def keyset_page(summaries: DataFrame, after: str | None, max_update: int, n: int) -> DataFrame:
    df = summaries.where(F.col("update_time") <= max_update)
    return (df if after is None else df.where(F.col("uuid") > after)).orderBy("uuid").limit(n)
