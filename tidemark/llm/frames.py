"""DataFrame plumbing shared by the operators: inputs, shared scratch tables, keys."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Arrow batches are bounded by bytes and rows, since Python workers hold a batch whole; shuffles are deleted with the query that made them.
_SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def settle(spark: SparkSession) -> None:
    """Sets the session's limits that the operators' memory and disk rely on."""
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; every other column of the input, whatever its name, stays out."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


class Saved:
    """A table written to the shared folder: lineage ends there and a lost executor loses nothing."""

    def __init__(self, df: DataFrame, spark: SparkSession | None = None):
        self.spark = spark or df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tidemark-{uuid.uuid4().hex}"
        settle(self.spark)
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema
        atexit.register(_delete, self.spark, self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


class Shipped:
    """A broadcast of any object. It travels as bytes that hold its class as well, so executors need no copy of this package on their path."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self._bytes.value)  # noqa: S301  made by the driver of this session


class Scratch:
    """Tables that are deleted when the block ends."""

    def __enter__(self) -> Scratch:
        self._made: list[Saved] = []
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self._made.append(Saved(df))
        return self._made[-1].df

    def __exit__(self, *_) -> None:
        for t in self._made:
            t.drop()


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join whatever the sizes: no side has a proven bound, and adaptive execution splits its hot keys."""
    return left.join(right.hint("merge"), on, how)


def salted_join(left: DataFrame, right: DataFrame, on: str, spread: str, parts: int = 16) -> DataFrame:
    """A join with a hot key on the left and one row for each key on the right: every key is `parts` tasks' work. `spread` deals the left rows."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(parts)))
    every = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return join(dealt, every, [on, "_salt"]).drop("_salt")


def text_key(text: str = "text") -> Column:
    """With doc_id, the key that joins results back to rows; rows alike in both share their results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def crc32_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % n


def null_first_id(col: str) -> Column:
    """A doc_id for joins: null becomes the least long."""
    return F.coalesce(F.col(col), F.lit(-(2**63)).cast("long"))
