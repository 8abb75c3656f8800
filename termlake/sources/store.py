"""Where intermediate tables go, and tables that are changed in place by buckets of their key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; where none is set, a temporary one on a local master and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="termlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds what Spark sends a Python worker at once by bytes, where the session has no bound: rows may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, for tables that several steps read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class BucketedTable:
    """A Parquet table whose rows lie in folders by a hash of their key, so that a change reads and rewrites only the folders it touches.

    Writes go through Spark's dynamic partition overwrite: the folders of one change are staged and then replaced. Writing a
    change again leaves the same rows. One writer at a time; there is no log of changes.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Writes a new table; an error if there is one."""
        self._write(rows.withColumn("bucket", self.bucket()), "errorifexists")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of these keys; `buckets` numbers at most."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("bucket")).distinct().collect())

    def of_buckets(self, buckets: list[int]) -> DataFrame:
        """The rows of these buckets; the other folders aren't opened."""
        return self.spark.read.parquet(self.path).filter(F.col("bucket").isin(buckets))

    def change(self, keys: DataFrame, how) -> list[int]:
        """Rewrites the buckets of the keys as how(their rows) tells; the buckets that were rewritten.

        A bucket that is left without rows is emptied.
        """
        buckets = self.touched(keys)
        if not buckets:
            return []
        old = self.of_buckets(buckets)
        # the new rows are told before any folder is replaced
        new = written(how(old.drop("bucket")).select(old.drop("bucket").columns).withColumn("bucket", self.bucket()), "change")
        full = {r[0] for r in new.select("bucket").distinct().collect()}
        if full:
            self._write(new, "overwrite")
        for b in set(buckets) - full:
            self._empty(b)
        return buckets

    def upsert(self, rows: DataFrame) -> list[int]:
        """Takes these rows in place of those with their keys, and adds the others; rows has one row a key and all columns."""
        return self.change(rows, lambda old: old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows.select(old.columns)))

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(keys, lambda old: old.join(keys.select(self.key), self.key, "left_anti"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode(mode).parquet(self.path)

    def _empty(self, bucket: int) -> None:
        schema = self.spark.read.parquet(self.path).drop("bucket").schema
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bucket={bucket}")

