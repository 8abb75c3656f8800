"""Tables that are changed by buckets, and the snapshot store of a stream: what is touched, and that a change played again changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from termlake.operators import reports, rounds, versions
from termlake.sources.store import BucketedTable
from termlake.streaming import streams


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rewritten(before, after):
    return {p.split("bucket=")[1].split("/")[0] for p, _ in set(before.items()) ^ set(after.items())}


@pytest.fixture
def table(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), "id", 16)
    t.create(spark.range(200).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")))
    return t


def test_changes_touch_their_buckets_only(spark, table):
    before = files(table.path)
    new = spark.createDataFrame([(5, "five"), (1000, "new")], "id long, name string")
    buckets = table.upsert(new)
    after = files(table.path)
    assert 1 <= len(buckets) <= 2 and rewritten(before, after) == {str(b) for b in buckets}
    want = {i: f"n{i}" for i in range(200)} | {5: "five", 1000: "new"}
    assert {r["id"]: r["name"] for r in table.read().collect()} == want and table.read().count() == 201
    table.upsert(new)
    assert {r["id"]: r["name"] for r in table.read().collect()} == want and table.read().count() == 201
    gone = table.delete(spark.createDataFrame([(1000,), (7,)], "id long"))
    assert rewritten(after, files(table.path)) <= {str(b) for b in {*gone, *buckets}}
    assert sorted(r["id"] for r in table.read().collect()) == sorted(set(range(200)) - {7})
    assert table.upsert(new.limit(0)) == [] and table.delete(spark.createDataFrame([], "id long")) == []
    # a bucket may lose all its rows
    one = table.touched(spark.createDataFrame([(3,)], "id long"))
    all_of_it = table.of_buckets(one).select("id")
    left = table.read().count() - all_of_it.count()
    table.delete(spark.createDataFrame(all_of_it.collect(), "id long"))
    assert table.read().count() == left
    with pytest.raises(Exception, match="exist"):
        table.create(table.read())


def test_a_read_of_some_buckets_opens_their_folders_only(spark, table):
    opened = table.of_buckets([3, 4]).inputFiles()
    assert opened and {f.split("bucket=")[1].split("/")[0] for f in opened} <= {str(b) for b in range(16)}
    plan = table.of_buckets([3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "PartitionFilters" in plan


def test_reviews_and_watches_in_place(spark, tmp_path):
    now = F.lit("2024-02-01").cast("timestamp")
    reviews = spark.range(60).select("id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("timestamp").alias("updated_at"))
    t = BucketedTable(spark, str(tmp_path / "r"), "id", 16)
    t.create(reviews)
    before = files(t.path)
    decisions = spark.createDataFrame([(3, "approved", "fine"), (999, "approved", "unknown")], "id long, status string, notes string")
    touched = rounds.decide_reviews(t, decisions, now)
    assert rewritten(before, files(t.path)) == {str(b) for b in touched} and len(touched) <= 2
    want = sorted(map(tuple, reports.update_reviews(reviews, decisions, now).collect()), key=str)
    assert sorted(map(tuple, t.read().select(reviews.columns).collect()), key=str) == want
    rounds.decide_reviews(t, decisions, now)
    assert sorted(map(tuple, t.read().select(reviews.columns).collect()), key=str) == want
    watch = spark.range(80).select(
        "id", F.concat(F.lit("https://site"), F.col("id").cast("string"), F.lit(".com")).alias("source_url"), F.lit(True).alias("enabled"), F.lit(3600).alias("check_frequency"),
        F.when(F.col("id") > 2, F.lit("2024-01-31 23:59:00").cast("timestamp")).alias("last_checked"), F.lit("New").alias("status"), F.lit(None).cast("timestamp").alias("changes_since"),
        F.lit(0).alias("change_count"), F.lit("").alias("change_summary"), F.sha2(F.lit("old"), 256).alias("last_hash"), F.lit(0.0).alias("risk_delta"), F.lit(4.0).alias("last_risk"), F.lit("old").alias("last_text"),
    )
    fetched = watch.select(F.col("source_url").alias("url"), F.lit("new text").alias("text"), F.lit(True).alias("ok"), F.lit(5.5).alias("risk"))
    w = BucketedTable(spark, str(tmp_path / "w"), "id", 16)
    w.create(watch)
    before = files(w.path)
    touched = rounds.refresh_watches(w, fetched, now)
    assert rewritten(before, files(w.path)) == {str(b) for b in touched} and len(touched) <= 3
    want = sorted(map(tuple, versions.watch_refresh(watch, fetched, now).select(watch.columns).collect()))
    assert sorted(map(tuple, w.read().select(watch.columns).collect())) == want
    assert rounds.refresh_watches(w, fetched, now) == []  # nothing is due any more
    assert {r["id"] for r in w.read().filter("status = 'Updated'").collect()} == {0, 1, 2}


def test_a_batch_played_again_changes_nothing(spark, tmp_path):
    store, schema = str(tmp_path / "store"), "url string, version int, captured_at string, text string"
    spark.createDataFrame([(f"u{k}", v, f"2024-01-0{v + 1}", "ab"[v % 2]) for k in range(30) for v in range(3)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_snapshots(s(), store, str(tmp_path / "c"), 16).start().awaitTermination(120)
    rows = lambda: sorted(map(tuple, spark.read.parquet(store).select("url", "text", "version").collect()))
    first = rows()
    assert len(first) == 60 and first[0] == ("u0", "a", 0)
    # the same batch under the same number, as after a crash between write and commit
    streams.stream_snapshots(s(), store, str(tmp_path / "c2"), 16).start().awaitTermination(120)
    assert rows() == first
    before = files(store)
    spark.createDataFrame([("u5", 9, "2024-02-01", "c"), ("u5", 8, "2024-01-20", "a")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.stream_snapshots(s(), store, str(tmp_path / "c"), 16).start().awaitTermination(120)
    assert len(rows()) == 61 and ("u5", "c", 9) in rows()
    assert len(rewritten(before, files(store)) - {"-1"}) == 1  # only u5's folder got a file


def test_legacy_watches_in_place(spark, tmp_path):
    now = F.lit("2024-01-01").cast("timestamp")
    site = lambda c: F.concat(F.lit("https://site"), c.cast("string"), F.lit(".com"))
    none = F.lit(None).cast("timestamp")
    watch = spark.range(60).select("id", F.lit("own").alias("vendor"), site(F.col("id")).alias("source_url"), F.lit("New").alias("status"), F.lit(None).cast("string").alias("user_id"), F.lit(86400).alias("check_frequency"), F.lit(True).alias("enabled"), none.alias("created_at"))
    legacy = spark.createDataFrame([(1, "https://site7.com", "u1", 600, "off"), (2, "https://new.org", "u2", 900, "yes"), (3, "", "u3", 1, "yes")], "id long, url string, user_id string, check_frequency int, enabled string").withColumn("created_at", none)
    t = BucketedTable(spark, str(tmp_path / "w"), "source_url", 16)
    t.create(watch)
    before = files(t.path)
    touched = rounds.take_over_legacy(t, legacy, now)
    assert rewritten(before, files(t.path)) == {str(b) for b in touched} and len(touched) <= 2
    key = lambda r: str(r["source_url"])
    want = sorted(versions.merge_legacy_watch(legacy, watch, now)[0].select(watch.columns).collect(), key=key)
    assert sorted(t.read().select(watch.columns).collect(), key=key) == want and len(want) == 61
    rounds.take_over_legacy(t, legacy, now)
    assert sorted(t.read().select(watch.columns).collect(), key=key) == want
