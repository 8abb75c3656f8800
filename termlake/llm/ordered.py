"""Running sums and neighbours in a global order, without a task that holds a whole key.

A table is range partitioned and sorted once and written with the number of its part. What a row needs from before it
comes from its own part by a window, and from earlier parts by a row per part that the driver holds: as many as
partitions. A key with a third of all rows is spread over a third of the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize


def parts_for(rows: int, spark: SparkSession, each: int = 100_000) -> int:
    return max(spark.sparkContext.defaultParallelism, min(20_000, rows // each))


def in_parts(df: DataFrame, n: int, keys: list[str], name: str) -> DataFrame:
    """df in n parts, with part and place, ascending by `keys` (nulls first); rows that tie are told apart by place."""
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    sorted_ = tie.repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    return materialize(sorted_.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), name)


def running(df: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """Adds to a table of in_parts(df, [key, ...]), for each (name, column) of sums, the column's sum over the key's rows up to this one."""
    own = Window.partitionBy("part", key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({k: F.sum(c).over(own) for k, c in sums.items()})
    # a key that goes on in a later part is the last of its part
    last = df.groupBy("part", key).agg(F.min("place").alias("first"), *[F.sum(c).alias(k) for k, c in sums.items()])
    ends = last.groupBy("part").agg(F.min_by(key, "first").alias("starts_with"), F.max_by(F.struct(key, *sums), "first").alias("end"), F.count("*").alias("kinds")).orderBy("part").collect()
    carried, before, held = [], None, dict.fromkeys(sums, 0)
    for r in ends:
        if before is not None and r["starts_with"] == before:
            carried.append((r["part"], before, *held.values()))
        else:
            held = dict.fromkeys(sums, 0)
        same = r["kinds"] == 1 and r["end"][key] == before
        before, held = r["end"][key], {k: (held[k] if same else 0) + r["end"][k] for k in sums}
    if not carried:
        return out
    kinds = dict(out.dtypes)
    schema = ", ".join([f"_p int, _k {kinds[key]}", *[f"_{k} {kinds[k]}" for k in sums]])
    more = F.broadcast(df.sparkSession.createDataFrame(carried, schema))  # a row for each part at most
    out = out.join(more, (F.col("part") == F.col("_p")) & (F.col(key) == F.col("_k")), "left")
    return out.withColumns({k: F.col(k) + F.coalesce(f"_{k}", F.lit(0)) for k in sums}).drop("_p", "_k", *[f"_{k}" for k in sums])


def neighbours(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds before and after to a table of in_parts(df, [key, value]): the value of the rows next to it with the same key."""
    own = Window.partitionBy("part", key).orderBy("place")
    out = df.withColumns({"before": F.lag(value).over(own), "after": F.lead(value).over(own)})
    at = F.struct("place", key, value)
    ends = df.groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last")).orderBy("part").collect()
    lines = []
    for a, b in zip(ends, ends[1:]):
        if a["last"][key] == b["first"][key]:
            lines += [(a["part"], a["last"]["place"], None, b["first"][value]), (b["part"], b["first"]["place"], a["last"][value], None)]
    if not lines:
        return out
    kind = dict(df.dtypes)[value]
    more = df.sparkSession.createDataFrame(lines, f"_p int, _place long, _before {kind}, _after {kind}")
    more = more.groupBy("_p", "_place").agg(F.max("_before").alias("_before"), F.max("_after").alias("_after"))
    out = out.join(F.broadcast(more), (F.col("part") == F.col("_p")) & (F.col("place") == F.col("_place")), "left")  # two rows for each part at most
    return out.withColumns({"before": F.coalesce("before", "_before"), "after": F.coalesce("after", "_after")}).drop("_p", "_place", "_before", "_after")
