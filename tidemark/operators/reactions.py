"""What events set off: tag and severity roll-ups, flapping, heartbeats, trigger rules and signals."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators.filters import EventFilter, condition


def tag_severities(
    summaries: DataFrame, flt: EventFilter | None = None, requested: list[str] | None = None, types: dict[str, str] | None = None
) -> DataFrame:
    """(tag, severity, events, acknowledged, total) over the summaries of a filter, with an array column tags; total sums event counts by tag.

    A tag that is listed twice in one summary counts once. Tags that are asked for and found nowhere have zeros and no severity.
    """
    rows = summaries.where(condition(flt, types)) if flt else summaries
    tags = rows.select(F.explode(F.array_distinct("tags")).alias("tag"), "severity", "status", "event_count")
    if requested is not None:
        tags = tags.where(F.col("tag").isin(*requested))
    per = tags.groupBy("tag", "severity").agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == model.ACKNOWLEDGED).alias("acknowledged"),
        F.sum("event_count").alias("n")
    )
    totals = per.groupBy("tag").agg(F.sum("n").alias("total"))
    out = per.join(totals, "tag").select("tag", "severity", "events", "acknowledged", "total")
    if requested is not None:
        asked = summaries.sparkSession.createDataFrame([(t,) for t in requested], "tag string")
        none = F.lit(0).cast("long")
        out = asked.join(out, "tag", "left").select(
            "tag", "severity", *(F.coalesce(c, none).alias(c) for c in ("events", "acknowledged", "total"))
        )
    return out


def flaps(events: DataFrame, key: str, threshold: int = model.WARNING, interval_s: int = 3600) -> DataFrame:
    """Events with prev, is_flap (below the threshold before, at least the threshold now) and n_flaps.

    n_flaps of a flap is the number of its key's flaps up to it and in the trailing interval; other events have 0. A key starts from CLEAR. Events
    without a key or an element's uuid are left out. Keys are worked through in blocks of one interval of time: the severity
    before a block comes from an aggregate, and a flap is also a witness in the next block.
    """
    rows = events.where(
        F.col("element_uuid").isNotNull() & (F.col("element_uuid") != "") & F.col(key).isNotNull()
    ).withColumn("second", F.expr("created div 1000"))
    rows = rows.withColumn("block", F.expr(f"second div {max(1, interval_s)}"))
    per = rows.groupBy(key, "block").agg(F.max(F.struct("created", "arrival_seq", "severity")).alias("l"))
    earlier = per.select(key, "block", F.lag("l.severity", 1, model.CLEAR).over(Window.partitionBy(key).orderBy("block")).alias("before"))
    w = Window.partitionBy(key, "block").orderBy("created", "arrival_seq")
    marked = rows.join(earlier, [key, "block"]).withColumn("prev", F.coalesce(F.lag("severity").over(w), "before")).drop("before")
    marked = marked.withColumn("is_flap", (F.col("prev") < threshold) & (F.col("severity") >= threshold))
    in_block = lambda b: F.struct((F.col("block") + b).alias("block"), F.lit(b == 0).alias("own"))
    seen = marked.withColumn("at", F.explode(F.when(F.col("is_flap"), F.array(in_block(0), in_block(1))).otherwise(F.array(in_block(0)))))
    seen = seen.withColumn("block", F.col("at.block")).withColumn("own", F.col("at.own")).drop("at")
    upto = F.count_if("is_flap").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gone = F.count_if("is_flap").over(
        Window.partitionBy(key, "block").orderBy("second").rangeBetween(Window.unboundedPreceding, -interval_s - 1)
    )
    counted = seen.withColumn("n_flaps", F.when(F.col("is_flap"), upto - gone).otherwise(F.lit(0).cast("long"))).where("own")
    return counted.drop("own", "block", "second")


def flap_alerts(flapped: DataFrame, count: int) -> DataFrame:
    return flapped.where(F.col("is_flap") & (F.col("n_flaps") >= count) & (F.col("n_flaps") % count == 0))


def latest_beats(beats: DataFrame) -> DataFrame:
    """The stored heartbeats after a batch: the last of each (monitor, daemon)."""
    return beats.groupBy("monitor", "daemon").agg(
        F.max(F.struct("last_time", "timeout_s")).alias("b")
    ).select("monitor", "daemon", "b.last_time", "b.timeout_s")


def heartbeats(beats: DataFrame, open_events: DataFrame, now_ms: int) -> DataFrame:
    """(monitor, daemon, action): error for a daemon whose time is up, clear for one that is back or unknown but has an open event."""
    last = latest_beats(beats).select("monitor", "daemon", (F.col("last_time") + F.col("timeout_s") * 1000 <= now_ms).alias("expired"))
    both = last.join(open_events.select("monitor", "daemon", F.lit(True).alias("open")).distinct(), ["monitor", "daemon"], "full_outer")
    action = F.when(F.col("expired"), "error").when(F.col("open"), "clear")
    return both.select("monitor", "daemon", action.alias("action")).where("action is not null")


def heartbeat_events(actions: DataFrame, now_ms: int) -> DataFrame:
    """The occurrences that heartbeats send back to the raw stream: an error or a clear for each (monitor, daemon)."""
    clear = F.col("action") == "clear"
    return actions.select(
        F.sha1(F.concat_ws("|", F.lit("heartbeat"), "monitor", "daemon", F.lit(str(now_ms)))).alias("uuid"),
        F.lit(now_ms).cast("long").alias("created"), F.lit("/Heartbeat").alias("event_class"),
        F.when(clear, model.CLEAR).otherwise(model.ERROR).alias("severity"), F.lit(model.NEW).alias("status"),
        F.col("monitor").alias("element_identifier"),
        F.concat_ws("|", "monitor", "daemon", F.lit("/Heartbeat")).alias("fingerprint"),
    )


def flap_events(alerts: DataFrame, event_class: str = "/Status/Flapping") -> DataFrame:
    """The occurrences that flap alerts send back to the raw stream."""
    return alerts.select(
        F.sha1(F.concat_ws("|", F.lit("flap"), "uuid")).alias("uuid"), "created", F.lit(event_class).alias("event_class"), "severity",
        F.lit(model.NEW).alias("status"),
        "element_identifier", F.concat_ws("|", "element_identifier", F.lit(event_class)).alias("fingerprint"),
        F.concat(F.lit("flapped "), "n_flaps", F.lit(" times")).alias("summary"),
    )


class _Rule(ast.NodeVisitor):
    """Compiles an expression of the rule language; anything else is refused."""

    def __init__(self, columns: dict[str, Column]):
        self.columns = columns

    def generic_visit(self, node):
        raise ValueError(f"not in the rule language: {type(node).__name__}")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node):
        return F.lit(node.value)

    def visit_Attribute(self, node):
        name = f"{node.value.id}.{node.attr}" if isinstance(node.value, ast.Name) else ""
        if name not in self.columns:
            raise ValueError(f"no such attribute: {name}")
        return self.columns[name]

    def visit_BoolOp(self, node):
        parts = [F.coalesce(self.visit(v).cast("boolean"), F.lit(False)) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out

    def visit_UnaryOp(self, node):
        if isinstance(node.op, ast.Not):
            return ~F.coalesce(self.visit(node.operand).cast("boolean"), F.lit(False))
        if isinstance(node.op, ast.USub):
            return -self.visit(node.operand)
        return self.generic_visit(node)

    def visit_Compare(self, node):
        left, out = self.visit(node.left), F.lit(True)
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            right = self.visit(right_node)
            if isinstance(op, ast.In | ast.NotIn):
                one = F.array_contains(right, left) if isinstance(right_node, ast.Attribute) and right_node.attr in ("groups", "systems") else right.contains(left)
                one = ~one if isinstance(op, ast.NotIn) else one
            else:
                one = {
                    ast.Eq: left.__eq__, ast.NotEq: left.__ne__, ast.Lt: left.__lt__, ast.LtE: left.__le__, ast.Gt: left.__gt__,
                    ast.GtE: left.__ge__
                }[type(op)](right)
            out, left = out & one, right
        return out

    def visit_Call(self, node):
        if not isinstance(node.func, ast.Attribute) or node.keywords:
            return self.generic_visit(node)
        target, name, args = self.visit(node.func.value), node.func.attr, [self.visit(a) for a in node.args]
        made = {
            "startswith": lambda c, a: c.startswith(a), "endswith": lambda c, a: c.endswith(a), "lower": F.lower, "upper": F.upper,
            "strip": F.trim
        }
        if name not in made or len(args) != (1 if name.endswith("with") else 0):
            raise ValueError(f"not in the rule language: {name}")
        return made[name](target, *args)


def rule(source: str, columns: dict[str, Column]) -> Column:
    """A trigger rule as a Column; a rule that is empty, wrong or touches what is missing is false."""
    try:
        cond = _Rule(columns).visit(ast.parse(source, mode="eval"))
    except (SyntaxError, ValueError, KeyError, TypeError):
        return F.lit(False)
    return F.coalesce(cond.cast("boolean"), F.lit(False))


def matched(events: DataFrame, triggers: dict[str, str], columns: dict[str, Column]) -> DataFrame:
    """(uuid, trigger) for every rule that an event satisfies; one pass over the events, whatever the number of rules."""
    hits = F.array_compact(F.array(*(F.when(rule(src, columns), F.lit(name)) for name, src in triggers.items())))
    return events.select("uuid", F.explode(hits).alias("trigger"))


NEVER = -1  # the flush_time of a spool that is not due again


def advance(events: DataFrame, matches: DataFrame, subscriptions: DataFrame, spool: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(signals, the spool) after a batch of events (uuid, status) that meets a spool (uuid, subscription, flush_time, sent).

    matches are all of the batch's; subscriptions have delay_seconds, repeat_seconds and send_initial. A signal has clear where its event
    is closed; spools of closed events go, and those of events outside the batch stay as they are.
    """
    now, delay, repeat = F.lit(now_ms).cast("long"), F.col("delay_seconds").cast("long") * 1000, F.col("repeat_seconds").cast("long") * 1000
    seen = events.groupBy("uuid").agg(F.max(F.col("status").isin(*model.OPEN_STATUSES)).alias("open"))
    hits = matches.select("uuid", "trigger").distinct().join(
        subscriptions.select("subscription", "trigger"), "trigger"
    ).join(seen.where("open").select("uuid"), "uuid").select("uuid", "subscription", F.lit(True).alias("hit"))
    both = spool.select(
        "uuid", "subscription", "flush_time", "sent", F.lit(True).alias("there")
    ).join(hits, ["uuid", "subscription"], "full_outer")
    all_ = both.join(seen, "uuid", "left").join(
        subscriptions.select("subscription", "delay_seconds", "repeat_seconds", "send_initial"), "subscription", "left"
    )
    there, hit, initial = F.coalesce("there", F.lit(False)), F.coalesce("hit", F.lit(False)), F.coalesce("send_initial", F.lit(False))
    at_once, closed = delay <= 0, ~F.coalesce("open", F.lit(True))
    first = F.when(delay > 0, now + delay).when(repeat > 0, now + repeat).otherwise(F.lit(NEVER).cast("long"))
    pulled = F.when(
        (repeat > 0) & ((F.col("flush_time") == NEVER) | (F.col("flush_time") > now + repeat)), now + repeat
    ).otherwise(F.col("flush_time"))
    known = F.col("open") & F.col("delay_seconds").isNotNull()
    again = F.when((repeat == 0) & ~initial & (F.col("flush_time") == NEVER), now + delay).otherwise(pulled)
    flush_time = (
        F.when(~hit, F.when(known, F.lit(NEVER).cast("long")).otherwise(F.col("flush_time")))
        .when(~there, first).when(at_once & ~initial, F.col("flush_time")).when(at_once, pulled).otherwise(again)
    )
    goes = hit & at_once & (~initial | ~there)
    sent = goes | F.coalesce("sent", F.lit(False))
    cleared = closed & there & F.coalesce("sent", F.lit(False))
    signals = all_.where(goes | cleared).select("uuid", "subscription", closed.alias("clear"))
    return signals, all_.where(~closed).select("uuid", "subscription", flush_time.alias("flush_time"), sent.alias("sent"))


def empty_spool(spark) -> DataFrame:
    return spark.createDataFrame([], "uuid string, subscription string, flush_time long, sent boolean")


def flush(
    spool: DataFrame, subscriptions: DataFrame, summaries: DataFrame, now_ms: int, triggers: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(signals due by now, the spool after them).

    Spools of closed and missing events go. Those whose subscription, or trigger (of triggers: trigger, enabled), is missing stay as they are. A disabled
    trigger sends nothing but its spool goes on; repeats go on unless acknowledged or not wanted.
    """
    due = (F.col("flush_time") <= now_ms) & (F.col("flush_time") != NEVER)
    subs = subscriptions.select("subscription", "trigger", "repeat_seconds")
    subs = subs.withColumn("enabled", F.lit(True)) if triggers is None else subs.join(triggers.select("trigger", "enabled"), "trigger")
    full = spool.withColumn("due", due).join(subs, "subscription", "left").join(summaries.select("uuid", "status"), "uuid", "left")
    open_ = F.coalesce(F.col("status").isin(*model.OPEN_STATUSES), F.lit(False))
    sends = F.col("due") & open_ & F.coalesce("enabled", F.lit(False))
    goes_on = F.col("due") & F.col("enabled").isNotNull()
    again = (F.col("repeat_seconds") > 0) & (F.col("status") != model.ACKNOWLEDGED)
    nxt = F.when(again, F.lit(now_ms).cast("long") + F.col("repeat_seconds") * 1000).otherwise(F.lit(NEVER).cast("long"))
    rest = full.where(~F.col("due") | open_)
    return full.where(sends).select("uuid", "subscription"), rest.select(
        "uuid", "subscription", F.when(goes_on, nxt).otherwise(F.col("flush_time")).alias("flush_time"),
        (F.col("sent") | sends).alias("sent")
    )


def nested_subscriptions(triggers: DataFrame, subscriptions: DataFrame, enabled_only: bool = False) -> DataFrame:
    """Each trigger with an array of its subscriptions, ordered by name; empty where it has none."""
    rows = triggers.where("enabled") if enabled_only else triggers
    own = subscriptions.groupBy("trigger").agg(
        F.array_sort(F.collect_list(F.struct("subscription", "delay_seconds", "repeat_seconds"))).alias("subscriptions")
    )
    none = F.expr("cast(array() as array<struct<subscription:string,delay_seconds:int,repeat_seconds:int>>)")
    return rows.join(own, "trigger", "left").withColumn("subscriptions", F.coalesce("subscriptions", none))


def replace_subscriptions(stored: DataFrame, subscriber: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subscriptions after a subscriber's list was set to `wanted`, those of the subscriber that were not in it and went)."""
    own = F.col("subscriber") == subscriber
    gone = stored.where(own).join(wanted.select("subscription"), "subscription", "left_anti")
    rest = stored.join(
        wanted.select("subscription"), "subscription", "left_anti"
    ).join(gone.select("subscription"), "subscription", "left_anti")
    return rest.unionByName(wanted.select(*stored.columns)), gone


def find_subscription(subscriptions: DataFrame, trigger: str, subscriber: str) -> DataFrame:
    return subscriptions.where((F.col("trigger") == trigger) & (F.col("subscriber") == subscriber))


def full_signals(signals: DataFrame, subscriptions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Signals with their trigger and subscriber, their event and, for cleared ones, the event that cleared it."""
    clearing = summaries.select(F.col("uuid").alias("cleared_by"), F.col("fingerprint").alias("clear_fingerprint"))
    event = summaries.select(
        "uuid", "fingerprint", "severity", "status", "event_count",
        *(["cleared_by"] if "cleared_by" in summaries.columns else [F.lit(None).cast("string").alias("cleared_by")])
    )
    return signals.join(
        subscriptions.select("subscription", "trigger", "subscriber"), "subscription"
    ).join(event, "uuid").join(clearing, "cleared_by", "left")
