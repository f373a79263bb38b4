"""Partitioned tables: the archive by day, the event-time log by hour; records as files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PartitionedTable:
    """A Parquet table with one folder for each unit of time; old units go by deleting their folders."""

    def __init__(self, spark: SparkSession, path: str, time: str, unit_ms: int, partition: str):
        self.spark, self.path, self.time, self.unit_ms, self.partition = spark, path, time, unit_ms, partition

    def append(self, rows: DataFrame) -> None:
        part = F.expr(f"{self.time} div {self.unit_ms}")
        rows.withColumn(self.partition, part).write.mode("append").partitionBy(self.partition).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _folders(self) -> list[tuple[int, object]]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(p)]
        return sorted(((int(n.split("=")[1]), q) for n, q in names if n.startswith(f"{self.partition}=")), key=lambda x: x[0])

    def partitions(self) -> list[int]:
        return [k for k, _ in self._folders()]

    def prune(self, now_ms: int, keep: int) -> list[int]:
        """Deletes the units that ended `keep` units before the present one, and names them."""
        gone = [(k, q) for k, q in self._folders() if k < now_ms // self.unit_ms - keep]
        for _, q in gone:
            q.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(q, True)
        return [k for k, _ in gone]

    def compact(self, part: int, files: int = 1) -> None:
        """Rewrites one unit into few files."""
        target = f"{self.path}/{self.partition}={part}"
        rows = self.spark.read.parquet(target)
        rows.coalesce(files).write.mode("overwrite").parquet(f"{self.path}/_compact-{part}")
        jvm = self.spark.sparkContext._jvm
        old, new = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(f"{self.path}/_compact-{part}")
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)


def event_times(events: DataFrame, processed_ms: int) -> DataFrame:
    """The rows of the event-time log: when each occurrence was processed, created and first seen."""
    first = F.coalesce("first_seen", "created") if "first_seen" in events.columns else F.col("created")
    return events.select("uuid", F.lit(processed_ms).cast("long").alias("processed"), "created", first.alias("first_seen"))


def write_csv(records: DataFrame, path: str) -> None:
    """Records as CSV files with a header; nulls are empty."""
    records.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(records: DataFrame, path: str, key: str | None = None) -> None:
    """Records as JSON lines, in folders by a key (a routing key, say) where one is named."""
    w = records.write.mode("append")
    (w.partitionBy(key) if key else w).json(path)


def publish(records: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    """Records as JSON messages of a topic, where the session has the connector; key is the column that messages are keyed by."""
    value = F.to_json(F.struct("*")).alias("value")
    rows = records.select(F.col(key).cast("string").alias("key"), value) if key else records.select(value)
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def fan_out(sinks: Iterable[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A micro-batch function that gives each batch to all sinks, computed once."""
    every = tuple(sinks)

    def run(batch: DataFrame, n: int) -> None:
        held = batch.persist()
        try:
            for sink in every:
                sink(held, n)
        finally:
            held.unpersist()

    return run
