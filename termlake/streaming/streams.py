"""The same operators over streams of documents, pages, snapshots and roll-up rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.catalog import RULES
from ..operators.rules import detect_findings
from ..operators.versions import dedup_snapshots


def stream_findings(docs: DataFrame, rules=RULES) -> DataFrame:
    """Stateless rule scan of arriving documents."""
    return detect_findings(docs, rules)


def _mean() -> Column:
    """Mean score; the sum is of decimals, so that it doesn't depend on the order of rows."""
    return (F.sum(F.col("crs").cast("decimal(18,10)")).cast("double") / F.count("crs")).alias("mean")


def _windowed(rows: DataFrame, window: Column) -> DataFrame:
    w = rows.groupBy(window.alias("w"))
    return w.agg(F.count("*").alias("n"), _mean()).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def stream_kpis(rows: DataFrame, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and mean score per event-time window, tumbling or sliding; rows later than `late` are dropped by the watermark."""
    return _windowed(rows.withWatermark("ts", late), F.window("ts", window, slide or window))


def stream_sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour", keys: tuple = ("industry",)) -> DataFrame:
    """Count and mean score per session: rows of one key with less than `gap` between neighbours."""
    s = rows.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), _mean())
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def stream_snapshots(stream: DataFrame, store: str, checkpoint: str, buckets: int = 64):
    """Appends snapshots whose (url, hash) the store never had; the store itself is the only state.

    The store lies in folders by a hash of the url and by batch. A batch reads the folders of its own urls only, and
    writes folders of its own number: when it is played again it replaces them, whatever of it was written before.
    An empty part is added first, so that there is a store to read, and a store that can't be read is an error and never taken for a new one.
    """
    key = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    fields = stream.withColumn("content_hash", F.lit("")).select("url", "content_hash", *[c for c in stream.columns if c != "url"]).withColumns({"bucket": F.lit(-1), "batch": F.lit(-1).cast("long")}).schema
    stream.sparkSession.createDataFrame([], fields).write.partitionBy("bucket", "batch").mode("append").parquet(store)

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", key)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many as buckets at most
        if not touched:
            return
        seen = batch.sparkSession.read.schema(fields).parquet(store).filter(F.col("bucket").isin(touched) & (F.col("batch") != number))
        fresh = dedup_snapshots(rows, seen).withColumn("batch", F.lit(number).cast("long")).select(*fields.names)
        fresh.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").mode("overwrite").parquet(store)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class _Watch(StatefulProcessor):
    """Of each url the last hash, text and score; an event per version, in the order of capture."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, risk double, version int")

    def handleInputRows(self, key, rows, timerValues):
        arrived = pd.concat(list(rows)).sort_values(["captured_at", "version"], kind="stable")
        last = self.last.get() if self.last.exists() else None
        out = []
        for v, at, h, risk in zip(arrived["version"], arrived["captured_at"], arrived["hash"], arrived["risk"], strict=True):
            status = "Updated" if last is not None and last[0] != h else "No Changes"
            out.append((key[0], int(v), at, status, h, 0.0 if last is None else round(risk - last[1], 2)))
            last = (h, float(risk), int(v))
        if last is not None:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["url", "version", "captured_at", "status", "hash", "risk_delta"])

    def close(self) -> None:
        pass


EVENTS = "url string, version int, captured_at timestamp, status string, hash string, risk_delta double"


def stream_watch(pages: DataFrame) -> DataFrame:
    """An event for each fetched page of pages(url, version, captured_at, text, risk): whether it changed since the one before, and by how much the risk moved.

    Only hashes and scores are kept as state, a row a url; needs the RocksDB state store. A batch that holds many
    versions of one url takes them in the order of capture.
    """
    slim = pages.select("url", F.col("version").cast("int").alias("version"), "captured_at", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.col("risk").cast("double").alias("risk"))
    return slim.groupBy("url").transformWithStateInPandas(_Watch(), EVENTS, "Append", "None")
