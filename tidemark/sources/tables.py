"""Reads event occurrences: the driver's tables in the event model's shape, and Parquet or JSON folders as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the driver's event types are graded.
SEVERITY = {"error": 4, "purchase": 3, "click": 2, "view": 1, "signup": 0}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as occurrences; arrival_seq is the arrival order, in which neighbours have changed places so that some come late."""
    e = read(spark, sf_dir, "events")
    severity = F.lit(0)
    for k, v in SEVERITY.items():
        severity = F.when(F.col("event_type") == k, v).otherwise(severity)
    status = F.when(F.col("event_id") % 10 == 0, 1).when(F.col("event_id") % 10 == 1, 2).otherwise(0)
    text = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    uid, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    micros = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.sha1(text("e|", uid)).alias("uuid"), F.col("event_id").bitwiseXOR(F.lit(5)).alias("arrival_seq"), F.expr("1").alias("count"),
        micros.alias("micros"),
        F.floor(micros / 1000).cast("long").alias("created"), text("/App/", F.col("event_type")).alias("event_class"),
        severity.alias("severity"), status.alias("status"),
        text("user-", user).alias("element_identifier"), F.sha1(text("u|", user)).alias("element_uuid"),
        text("user-", user, "|", F.col("event_type")).alias("fingerprint"),
        k.alias("k"), F.when(k.isNotNull(), F.array(k)).alias("detail_k"), F.col("user_id"), F.col("event_type"), "value",
        text(
            "10.", (F.col("user_id") / 65536).cast("long").cast("string"), ".",
            ((F.col("user_id") / 256).cast("long") % 256).cast("string"), ".", (F.col("user_id") % 256).cast("string")
        ).alias("ip"),
        F.array(F.col("event_type"), text("g", (F.col("user_id") % 7).cast("string"))).alias("tags"),
    ).withColumn("created", F.expr("micros div 1000")).drop("micros")


def stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """A folder as a stream; files per trigger are the back-pressure."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def parse_messages(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, messages that are none, with the reason) of a frame with a column value of JSON text, from whatever broker or folder it comes."""
    kind = f"{schema}, _broken string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    read_ = raw.withColumn("e", F.from_json(F.col("value").cast("string"), kind, options))
    broken = F.col("value").isNull() | F.col("e").isNull() | F.col("e._broken").isNotNull()
    return read_.where(~broken).select("e.*").drop("_broken"), read_.where(broken).select("value", F.lit("not an event").alias("reason"))


def broker(spark: SparkSession, servers: str, topic: str, per_trigger: int = 10_000) -> DataFrame:
    """A topic as a stream of messages (value), where the session has the connector; offsets per trigger are the back-pressure."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_trigger).load().select("value")
    )
