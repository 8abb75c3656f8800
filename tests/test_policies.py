"""Policy operators: small hand-computed cases, and every query against its SQL."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from termlake.functions import catalog, text
from termlake.operators import retrieval, rollups, rules, scoring, versions
from termlake.plans.queries import ORACLE_SQL, QUERIES
from termlake.streaming import streams

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "quantize"):
        return round(float(v), 9)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "events", "pages", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    got = sorted((repr([plain(r[c]) for c in names]) for r in df.collect()))
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_findings_of_edge_texts(spark):
    d = docs(spark, "", None, "We use cookies", "🙂🙂 cookies\r\nand cookie", "x" * 6000 + " cookies")
    rows = {r["doc_id"]: r for r in rules.detect_findings(d).collect()}
    assert sorted(rows) == [2, 3, 4]
    assert rows[3]["start_offset"] == 3 and rows[3]["end_offset"] == 10 and rows[2]["end_offset"] == 14
    assert rows[2]["irp_score"] == 0.7 and abs(rows[2]["confidence"] - 0.91) < 1e-9


def test_sentence_context(spark):
    d = spark.createDataFrame([("One. Two! Three? Four",)], "t string")
    assert d.select(rules.sentence_context(F.col("t")), rules.sentence_context(F.col("t"), after=True), rules.sentence_context(F.lit("only"))).first()[:] == ("Three Four", "One Two", "only")


def test_grades_and_readiness(spark):
    g = spark.createDataFrame([(8.5,), (7.5,), (6.5,), (5.5,), (4.5,), (3.5,), (3.4,)], "s double").select(scoring.grade(F.col("s"))).collect()
    assert [r[0] for r in g] == ["D+", "C", "C+", "B-", "B", "A-", "A"]
    a = spark.createDataFrame([(7.0, 0.9, 1.0), (3.9, 0.65, 0.63), (3.9, 0.65, 0.62), (3.0, 0.9, 0.37)], "r double, c double, k double")
    assert [r[0] for r in a.select(scoring.action_readiness(F.col("r"), F.col("c"), F.col("k"))).collect()] == ["Stop", "Go", "Review", "Stop"]


def test_repeated_context_doubles_its_weight(spark):
    d = spark.createDataFrame([("Tracking / Profiling", ["for_child", "for_child"]), ("Tracking / Profiling", []), ("Liability", ["for_work"])], "c string, x array<string>")
    assert [r[0] for r in d.select(scoring.context_weight(F.col("c"), F.col("x"))).collect()] == [3.0, 1.0, 3.0]


def test_unknown_severity_is_an_error(spark):
    d = spark.createDataFrame([("Odd",)], "s string").select(scoring.bump_severity(F.col("s"), F.lit("x"), F.lit("y"), catalog.DOC_TYPE_BOOSTS))
    with pytest.raises(Exception, match="unknown severity"):
        d.collect()


def test_chunks_keep_whole_lines_and_overlap(spark):
    t = "".join(f"{k:02d}" + "a" * 37 + "\n" for k in range(6))
    rows = text.chunk_text(docs(spark, t, ""), size=100, overlap=40).orderBy("doc_id", "n").collect()
    assert [(r["start"], len(r["chunk"])) for r in rows] == [(0, 80), (40, 80), (80, 80), (120, 80), (160, 80)]


def test_rrf_and_budget(spark):
    a = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.5)], "query_id int, chunk_id int, score double")
    r = retrieval.ranks(a)
    assert [x["rank"] for x in r.orderBy("chunk_id").collect()] == [1, 2, 3]
    f = {x["chunk_id"]: x["score"] for x in retrieval.rrf([r, r]).collect()}
    assert abs(f[1] - 2 / 61) < 1e-12
    assert retrieval.budget(r.withColumn("len", F.lit(10)), "len", 20).count() == 2


def test_kappa_of_total_chance_agreement_is_zero(spark):
    d = docs(spark, "a", "b")
    none = spark.createDataFrame([], "doc_id long, category string")
    row = rollups.scores(rollups.confusion(none, none, d, ["X"])).first()
    assert (row["tn"], row["f1"], row["kappa"]) == (2, 0.0, 0.0)


def test_token_diff_aligns(spark):
    p = spark.createDataFrame([("u", 1, "we sell data.", "we share data!")], "url string, version int, old_text string, text string")
    got = [(r["token"], r["type"], r["severity"]) for r in versions.token_diff(p).orderBy("n").collect()]
    assert got == [("sell", "removed", "low"), ("share", "added", "medium"), (".", "removed", "low"), ("!", "added", "low")]


def test_stream_equals_batch(spark, tmp_path):
    d = docs(spark, "cookies here", "nothing", "binding arbitration")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_findings(s).select("doc_id", "category").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, rules.detect_findings(d).select("doc_id", "category").collect()))
