"""Streams: micro-batches fold into a versioned summary table; flapping keeps keyed state with a time limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

import tidemark
from tidemark import model
from tidemark.operators import state
from tidemark.sinks import scratch

# Functions of this package go to executors by value, so these need no copy of it on their path.
cloudpickle.register_pickle_by_value(tidemark)

OLD, EVENT, CLEAR = range(3)


def _lives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a key in arrival order, with the life of their fingerprint (it ends by a clear) and, for clears, the lives they end."""
    key, active, lives = None, {}, {}
    for rb in batches:
        life, ended = [], []
        columns = (rb.column(c).to_pylist() for c in ("key", "kind", "hash", "clear_hash", "created", "status"))
        for k, kind, h, clear_hash, created, status in zip(*columns, strict=True):
            if k != key:
                key, active, lives = k, {}, {}
            if kind == CLEAR:
                gone = [f for f, (c, seen, s) in active.items() if c == clear_hash and seen <= created and s in model.OPEN_STATUSES]
                ended.append([{"hash": f, "life": lives[f]} for f in gone])
                life.append(None)
                for f in gone:
                    del active[f]
                    lives[f] += 1
                continue
            lives.setdefault(h, 0)
            if kind == EVENT and status in model.CLOSED_STATUSES:  # stored by itself, nothing can clear it
                life.append(lives[h])
                ended.append([])
                continue
            if h not in active or created >= active[h][1]:
                active[h] = (clear_hash, created, status)
            life.append(lives[h])
            ended.append([])
        kind = pa.list_(pa.struct([("hash", pa.string()), ("life", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [*rb.columns, pa.array(life, pa.int32()), pa.array(ended, kind)], names=[*rb.schema.names, "life", "ended"]
        )


def apply_in_order(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Summaries after a batch of occurrences with clear_hash, and clear_hashes where they are CLEAR.

    In arrival order, a CLEAR occurrence ends the open events of its hashes that were last seen by then: they become
    cleared, with cleared_by, and the next occurrence of their fingerprint starts a new summary. It is kept itself, closed,
    if it ended any; otherwise it is dropped. The arrivals of a clear hash go through one task; hashes
    that a fingerprint changes between go together.
    """
    is_clear = F.col("severity") == model.CLEAR
    named = batch.withColumn(
        "hash", state.fingerprint_hash(F.col("fingerprint"))
    ).withColumn("kind", F.when(is_clear, CLEAR).otherwise(EVENT))
    events = named.where(~F.coalesce(is_clear, F.lit(False))).drop("clear_hashes")
    ends = named.where(is_clear).withColumn(
        "clear_hash", F.explode(F.array_distinct("clear_hashes"))
    ).drop("clear_hashes").where("clear_hash is not null")
    rows = events.unionByName(ends)
    idle = F.col("status").isin(model.CLOSED, model.CLEARED)
    if old is not None:
        held = old.where(~idle).select(
            F.col("fingerprint_hash").alias("hash"), F.lit(OLD).alias("kind"), F.lit(None).cast("long").alias("arrival_seq"),
            F.col("last_seen").alias("created"), "status", "clear_hash", "uuid"
        )
        rows = rows.unionByName(held, allowMissingColumns=True)
    own = F.coalesce("clear_hash", F.concat(F.lit("f|"), "hash"))
    linked = rows.where(F.col("kind") != CLEAR).groupBy("hash").agg(
        F.collect_set(own).alias("all")
    ).where("size(all) > 1").select(F.explode("all").alias("key")).distinct()
    keyed = rows.withColumn("key", own).join(
        linked.withColumn("link", F.lit("*")), "key", "left"
    ).withColumn("key", F.coalesce("link", "key")).drop("link")
    ordered = keyed.repartition("key").sortWithinPartitions("key", F.col("arrival_seq").asc_nulls_first(), "uuid")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    done = scratch.cut(ordered.mapInArrow(_lives, ddl + ", life int, ended array<struct<hash:string,life:int>>"))
    held = None if old is None else old.where(~idle).drop("cleared_by").withColumn("life", F.lit(0))
    new = state.dedup(done.where(F.col("kind") == EVENT).drop("hash"), held)
    clears = done.where((F.col("kind") == CLEAR) & (F.size("ended") > 0))
    by = clears.select(
        F.explode("ended").alias("e"), F.col("uuid").alias("cleared_by"), F.col("created").alias("at")
    ).select(F.col("e.hash").alias("fingerprint_hash"), F.col("e.life").alias("life"), "cleared_by", "at")
    out = new.join(by, ["fingerprint_hash", "life"], "left")
    gone = F.col("cleared_by").isNotNull()
    salted = F.sha1(F.concat_ws("|", "fingerprint", "at", "cleared_by", "life"))
    out = out.withColumn(
        "fingerprint_hash", F.when(gone, salted).otherwise(F.col("fingerprint_hash"))
    ).withColumn("status", F.when(gone, model.CLEARED).otherwise(F.col("status"))).drop("life", "at")
    stored = clears.dropDuplicates(["uuid", "arrival_seq"]).select(
        "uuid", F.sha1(F.concat_ws("|", "fingerprint", F.col("created") - 1, "uuid", "arrival_seq")).alias("fingerprint_hash"),
        "fingerprint", "event_class", "severity", F.lit(model.CLOSED).alias("status"), "element_identifier", "element_uuid",
        F.col("count").cast("long").alias("event_count"), F.col("created").alias("first_seen"), F.col("created").alias("last_seen"),
        F.col("created").alias("status_change"), F.lit(None).cast("string").alias("clear_hash"),
        F.lit(None).cast("string").alias("cleared_by"),
    )
    out = out.unionByName(stored, allowMissingColumns=True)
    return out if old is None else out.unionByName(old.where(idle), allowMissingColumns=True)


def flap_alerts(events: DataFrame, key: str, count: int, threshold: int = model.WARNING, interval_s: int = 3600) -> DataFrame:
    """(key, uuid, n_flaps) of a stream's occurrences that reactions.flap_alerts names in a batch.

    A key's state is its last severity and the seconds of its flaps in the interval; it goes when the key is silent for
    the interval, and the key then starts from CLEAR. In a micro-batch a key's occurrences count in the order of (created, arrival_seq). A run with availableNow ends only where
    spark.sql.streaming.noDataMicroBatches.enabled is false: Spark goes on with empty batches to look for time-outs.
    """

    def run(k, chunks: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        prev, times = kept.get if kept.exists else (model.CLEAR, [])
        times, out = list(times), []
        for _, created, severity, uuid in sorted(
            (s, c, v, u) for x in chunks for c, s, v,
            u in zip(
                x["created"].tolist(), zip(x["created"].tolist(), x["arrival_seq"].tolist(), strict=True), x["severity"].tolist(),
                x["uuid"].tolist(), strict=True
            )
        ):
            now = created // 1000
            if prev < threshold <= severity:
                times.append(now)
                n = sum(t >= now - interval_s for t in times)
                if n >= count and n % count == 0:
                    out.append((k[0], uuid, n))
            times, prev = [t for t in times if t >= now - interval_s], severity
        kept.update((prev, times))
        kept.setTimeoutDuration(interval_s * 1000)
        yield pd.DataFrame(out, columns=["key", "uuid", "n_flaps"])

    seen = events.where(
        F.col("element_uuid").isNotNull() & (F.col("element_uuid") != "") & F.col(key).isNotNull()
    ).select(F.col(key).cast("string").alias("key"), "created", "arrival_seq", "severity", "uuid")
    return seen.groupBy("key").applyInPandasWithState(
        run, "key string, uuid string, n_flaps long", "prev int, times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


class SummaryTable:
    """Versions of the summary table in a folder, in 256 parts by the hash; a version's manifest says which version holds each part.

    A micro-batch writes only the parts that its fingerprints are in, under its own version, and then its manifest; what is not in the
    manifest does not count, so a micro-batch that is run again after a failure counts once. Folders that the last two manifests
    do not name are deleted. There is no watermark: late occurrences are merged, never dropped. CLEAR occurrences act on
    the table in arrival order where occurrences have clear_hash and clear_hashes (the array of what a CLEAR ends); they can reach any
    part, so such a batch writes all of them. Without these columns nothing can be cleared, and CLEAR occurrences fold as ordinary ones.
    """

    def __init__(self, spark: SparkSession, path: str, sinks: tuple[Callable[[DataFrame, int], None], ...] = ()):
        """sinks are given the valid occurrences of each batch, after its version is written."""
        self.spark, self.path, self.sinks = spark, path, sinks

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, n: int) -> bool:
        fs, p = self._path(f"manifest={n:012d}/_SUCCESS")
        return fs.exists(p)

    def _manifest(self, n: int) -> dict[str, int]:
        return {
            r["part"]: r["v"] for r in self.spark.read.schema("part string, v long").parquet(f"{self.path}/manifest={n:012d}").collect()
        }  # 256 rows at most

    def _parts(self, manifest: dict[str, int], parts: set[str]) -> DataFrame | None:
        paths = [f"{self.path}/v={v:012d}/part={p}" for p, v in sorted(manifest.items()) if p in parts]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, n: int) -> DataFrame:
        manifest = self._manifest(n)
        return self._parts(manifest, set(manifest))

    def fold(self, batch: DataFrame, n: int) -> None:
        if n > 0 and not self._exists(n - 1):
            raise RuntimeError(f"version {n - 1} of the table is missing: its state can't be folded into")
        manifest, valid = self._manifest(n - 1) if n > 0 else {}, state.validate(batch)
        part = F.substring("fingerprint_hash", 1, 2)
        if {"clear_hash", "clear_hashes"} <= set(batch.columns):
            new, stays = apply_in_order(self._parts(manifest, set(manifest)), valid), {}
        else:
            hashes = valid.select(
                state.occurrence_hash(F.col("fingerprint"), F.col("status"), F.col("severity"), F.col("created")).alias("fingerprint_hash")
            )
            touched = {r["part"] for r in hashes.select(part.alias("part")).distinct().collect()}  # 256 at most
            new, stays = state.dedup(valid, self._parts(manifest, touched)), manifest
        new.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/v={n:012d}")
        fs, p = self._path(f"v={n:012d}")
        written = [f.getPath().getName().removeprefix("part=") for f in fs.listStatus(p) if f.isDirectory()]
        now = stays | dict.fromkeys(written, n)
        self.spark.createDataFrame(
            list(now.items()), "part string, v long"
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest={n:012d}")
        for sink in self.sinks:
            sink(valid, n)
        used = {*now.values(), *manifest.values()}
        for f in self._path("")[0].listStatus(self._path("")[1]):
            kind, _, v = f.getPath().getName().partition("=")
            if v.isdigit() and (kind == "v" and int(v) < n and int(v) not in used or kind == "manifest" and int(v) < n - 1):
                self._path("")[0].delete(f.getPath(), True)

    def run(self, events: DataFrame, checkpoint: str):
        """Everything that is there now, in micro-batches."""
        return events.writeStream.foreachBatch(lambda df, n: self.fold(df, n)).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start()


class LatestTable:
    """Versions of a table of the last row of each key, folded from micro-batches; heartbeats, say."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], by: str):
        self.spark, self.path, self.keys, self.by = spark, path, keys, by

    def read(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={n:012d}")

    def fold(self, batch: DataFrame, n: int) -> None:
        rest = [c for c in batch.columns if c not in (*self.keys, self.by)]
        rows = batch if n == 0 else self.read(n - 1).unionByName(batch)
        last = rows.groupBy(*self.keys).agg(F.max(F.struct(self.by, *rest)).alias("r"))
        last.select(*self.keys, "r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{self.path}/v={n:012d}")

    def run(self, rows: DataFrame, checkpoint: str):
        return rows.writeStream.foreachBatch(lambda df, n: self.fold(df, n)).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start()


def index_changes(
    changes: DataFrame, load: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, DataFrame], None], checkpoint: str, hooks=None
):
    """Runs a stream of changed uuids through an index: each batch's uuids once, those that still have a row to be written, the others deleted.

    The checkpoint is the queue: a batch that fails is run again, and writing a row twice is the same as writing it once.
    """

    def run(batch: DataFrame, n: int) -> None:
        uuids = batch.select("uuid").dropDuplicates(["uuid"]).persist()
        try:
            rows = load(uuids)
            write(rows, uuids.join(rows.select("uuid"), "uuid", "left_anti"))
            if hooks is not None:
                hooks.indexed(rows)
        finally:
            uuids.unpersist()

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
