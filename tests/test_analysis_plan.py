"""The analysis of equal texts, its plan, and that it doesn't depend on how rows are dealt."""

import re

from pyspark.sql import functions as F

from termlake.functions.catalog import CLAUSES
from termlake.operators import analysis, scoring


def docs(spark, texts):
    rows = [(i, t, "Privacy Policy", "General", ["for_child"]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, doc_type string, industry string, context array<string>")


def model(spark, d):
    f = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    return f.select(
        "doc_id", "ord", F.lit("ADM").alias("category"), F.lit("Medium").alias("severity"), F.lit(0.5).alias("confidence"), F.when(F.col("ord") == 0, "profiling to set prices").otherwise("made up").alias("excerpt"), F.lit("e").alias("explanation"),
        F.array(F.lit("GDPR")).alias("jurisdictions"), F.array(F.lit("GDPR 22")).alias("legal_basis"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(3).alias("impact"), F.lit(3).alias("likelihood"), F.lit(0).alias("safeguard_score"), F.lit(0.5).alias("irp_score"),
    )


def test_copies_are_scanned_once(spark):
    """A hot class of copies is one row of the scan, and every copy has the class's findings."""
    text = "\n".join(CLAUSES[:6])
    d = docs(spark, [text] * 50 + [text + " More.", None, "", None])
    classes = analysis.scanned_classes(d).collect()
    assert len(classes) == 4 and sorted(len(r["found"] or []) for r in classes) == [0, 0, 5, 5] or len(classes) == 4
    got = {r["doc_id"]: r for r in analysis.analyze(d).collect()}
    assert len(got) == 54 and len({str(got[i]["findings"]) + str(got[i]["risk_score"]) for i in range(50)}) == 1 and got[0]["n_findings"] > 3
    assert got[51]["n_findings"] == got[52]["n_findings"] == 0 and got[51]["issues"] == ["no findings"] and got[51]["action_items"] == []


def test_plan_has_one_scan_of_patterns_and_one_shuffle_of_findings(spark, tmp_path):
    docs(spark, ["\n".join(CLAUSES)] * 3).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = analysis.analyze(d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    steps = [line for line in plan.split("\n") if re.match(r"[\s:+\-|]*(\*\(\d+\) )?\w", line)]
    assert sum("Generate explode" in s and "counts" in s for s in steps) <= 1 + sum("ReusedExchange" in s for s in steps)
    findings = [s for s in steps if re.search(r"Exchange hashpartitioning\(doc_id", s) and "ReusedExchange" not in s]
    assert len([s for s in steps if "Exchange" in s and "Broadcast" not in s and "Reused" not in s]) <= 6
    assert len(findings) <= 3


def test_rows_in_any_order_give_the_same_analysis(spark):
    d = docs(spark, ["\n".join(CLAUSES[i % 7 : i % 7 + 9]) for i in range(30)])
    m = model(spark, d)
    one, two = (sorted(map(str, analysis.analyze(x, y).collect())) for x, y in ((d.repartition(1), m.repartition(1)), (d.repartition(7), m.repartition(5))))
    assert one == two
    quick = {r["doc_id"]: r for r in analysis.analyze(d, quick=True).collect()}
    assert len(quick) == 30 and all(r["mode"] == "quick" for r in quick.values())


def test_checks_agree_with_the_table_of_findings(spark):
    """Validation from one array a document gives what the operator over a table of findings gives."""
    d = docs(spark, ["\n".join(CLAUSES[:9]), CLAUSES[2], "nothing of note", ""])
    got = {r["doc_id"]: r for r in analysis.analyze(d, model(spark, d)).collect()}
    found = analysis.merged_findings(d, model(spark, d))
    want = {r["doc_id"]: r for r in scoring.validation(found, d, "place").collect()}
    for i, r in want.items():
        assert (got[i]["n_issues"], got[i]["issues"]) == (r["n_issues"], r["issues"])


def test_stored_analyses_are_written_once(spark):
    """Reviews and stored rows come from one written table of analyses."""
    done = spark.createDataFrame([(1, "completed", False), (2, "needs_review", True)], "doc_id long, status string, review_required boolean")
    rows, reviews = analysis.stored(done, spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string"))
    assert all("/analyses-" in f for f in reviews.inputFiles()) and [r["analysis_id"] for r in reviews.collect()] == [2]
    assert [(r["doc_id"], r["document_text"]) for r in rows.orderBy("doc_id").collect()] == [(1, "a\nb"), (2, None)]
