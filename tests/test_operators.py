"""Hand-computed cases of the policy operators, and streams against batches."""

import re
import collections
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from termlake.functions import catalog, text
from termlake.operators import advice, analysis, inference, reports, retrieval, rollups, rules, scoring, signals, versions
from termlake.sources import readers
from termlake.streaming import streams


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- scan ---------------------------------------------------------------------------------------
def test_anchors_stand_in_every_match():
    patterns = [p for r in [*catalog.RULES, *catalog.wide_rules()] for p in r.patterns]
    assert len(patterns) > 240 and all(catalog.anchor(p) for r in catalog.RULES for p in r.patterns)
    patterns = [p for p in patterns if catalog.anchor(p)]
    spelt = [re.sub(r"\\b|\(|\)", "", p) for p in patterns]
    texts = catalog.CLAUSES + [r.example for r in catalog.wide_rules()] + [re.sub(r"\.\{0,\d+\}", " my ", s).replace("?", "") for s in spelt]
    hit = 0
    for p in patterns:
        for t in texts:
            for m in re.finditer(p, t, re.I):
                hit += 1
                assert catalog.anchor(p) in m[0].lower(), (p, m[0])
    assert hit > 200


def test_letters_that_fold_to_ascii_still_match(spark):
    d = docs(spark, "we \u017fell your data", "tracKing \u212aookies pixel", "W\u0131th cookies", "nothing")
    got = {r["doc_id"] for r in rules.rule_hits(d).collect()}
    assert got >= {0, 2} and 3 not in got


def test_carried_columns_and_hits_only_agree_with_findings(spark):
    d = docs(spark, *catalog.CLAUSES).withColumn("mark", F.col("doc_id") + 1)
    a = {(r["doc_id"], r["ord"], r["mark"], r["category"], round(r["confidence"], 9)) for r in rules.rule_hits(d, carry=("mark",)).collect()}
    b = {(r["doc_id"], r["ord"], r["mark"], r["category"], round(r["confidence"], 9)) for r in rules.detect_findings(d, carry=("mark",)).collect()}
    assert a == b and a
    assert rules.rule_hits(d, codes=["nowhere"]).count() == 0


def test_quick_scan_finds_every_match(spark):
    rows = rules.detect_quick(docs(spark, "children\nand children under 13")).orderBy("pattern", "n").collect()
    assert [(r["pattern"], r["n"], r["line_start"]) for r in rows if r["category"] == "Minors"] == [(0, 0, 2), (1, 0, 1), (1, 1, 2)]
    assert all(r["confidence"] == 0.8 and r["irp_score"] is not None for r in rows)


def test_a_pathological_text_is_scanned_in_time(spark):
    d = docs(spark, "sell " * 20_000, "a" * 100_000, "transfer x " * 9000)
    rules.rule_hits(docs(spark, "sell data")).collect()
    began = time.time()
    rules.rule_hits(d).collect()
    inference.infer_all(d.withColumn("url", F.lit("a.com"))).collect()
    assert time.time() - began < 20


# --- inference ----------------------------------------------------------------------------------
@pytest.mark.parametrize(("url", "words", "codes"), [
    ("https://x.co.uk/a", "", ["UK-GDPR"]), ("x.com", "prices in € and Datenschutz", ["GDPR"]), ("x.com", "€ only", []), ("x.com", "£ in the United Kingdom", ["UK-GDPR"]),
    ("x.com", "the CPA", []), ("x.com", "the CPA of Colorado", ["US-CO"]), ("x.com", "SB  205", ["US-CO"]), ("x.com", "datos personales, personenbezogene Daten", ["GDPR"]), ("x.com", "datos personales", []),
    ("x.de", "datos personales; HIPAA; ftc", ["GDPR", "US-FED"]), ("x.com", "the FTC and California residents", ["US-FED", "US-CA"]), ("x.com", "Regulation (EU) 2016/679", ["GDPR"]), ("x.com", "APPs", ["APP"]), ("x.com", None, []),
])
def test_jurisdictions(spark, url, words, codes):
    d = spark.createDataFrame([(1, url, words)], "doc_id long, url string, text string")
    row = inference.infer_all(d).first()
    assert row["jurisdictions"] == codes and row["location_needed"] == (not codes) and ("fallback" in row["detected_signals"]) == (not codes)


@pytest.mark.parametrize(("url", "words", "kind", "industry"), [
    ("https://facebook.com/x", "bank", "Privacy Policy", "Social Media"), ("https://a.openai.com/privacy", "", "Privacy Policy", "AI / Tech Platform"), ("https://x.gov.uk/tos", "bank", "Terms of Service", "General"),
    ("https://y.com/", "arbitration applies", "Terms of Service", "General"), ("https://y.com/", "Privacy Policy. You agree to this.", "Combined", "General"), ("https://shop.com/cookies", "", "Cookie Policy", "Retail"),
    ("https://x.edu/dpa", "", "Data Processing Agreement", "Education"), (None, "x " * 15_000 + "hospital patient", "Privacy Policy", "Healthcare"), (None, None, None, None), ("https://y.com/bank", None, "Privacy Policy", "Finance"),
])
def test_types_and_industries(spark, url, words, kind, industry):
    d = spark.createDataFrame([(1, url, words)], "doc_id long, url string, text string")
    row = inference.infer_all(d).first()
    assert (row["doc_type"], row["industry"]) == (kind, industry)


# --- findings to verdicts -----------------------------------------------------------------------
def test_malformed_model_findings_are_skipped(spark):
    one = '{"category":"ADM","severity":"High","confidence":%s,"excerpt":"x","explanation":"e","jurisdictions":["GDPR"],"evidence":{"line_start":%s,"line_end":2,"legal_basis":["A"]}}'
    body = '{"findings":[' + ",".join([one % ("0.5", "1"), one % ("1.5", "1"), one % ("0.9", "0"), one.replace("High", "Odd") % ("0.5", "1"), one % ("0.9", "2")]) + "]}"
    got = scoring.parse_model_findings(spark.createDataFrame([(1, body), (2, "not json"), (3, None)], "doc_id long, body string")).orderBy("ord").collect()
    assert [(r["doc_id"], r["ord"], r["needs_review"], r["irp_score"]) for r in got] == [(1, 0, True, 0.44), (1, 4, False, 0.44)]


@pytest.mark.parametrize("change,fine", [
    ({}, True), ({"impact": 2.5}, False), ({"impact": 3.0}, True), ({"impact": "4"}, True), ({"impact": "x"}, False), ({"impact": None}, False), ({"impact": [1]}, False), ({"impact": 6}, False),
    ({"irp_score": None}, True), ({"irp_score": 1.2}, False), ({"confidence": "0.7"}, True), ({"confidence": True}, True), ({"category": 7}, False), ({"excerpt": None}, False), ({"explanation": ...}, False),
    ({"jurisdictions": "GDPR"}, False), ({"jurisdictions": ["GDPR", 3]}, False), ({"jurisdictions": ["Nowhere"]}, False), ({"jurisdictions": []}, True), ({"evidence": [1]}, False), ({"evidence": None}, False),
    ({"evidence": {"line_start": 1, "line_end": 1}}, True), ({"evidence": {"line_start": 1, "line_end": 1, "legal_basis": None}}, False), ({"evidence": {"line_start": 1, "line_end": 1.5}}, False), ({"needs_review": "maybe"}, False), ({"extra": {"a": [1]}}, True),
])
def test_every_item_is_checked_by_itself(spark, change, fine):
    """An item that is wrong goes alone, whatever is wrong with it."""
    one = {"category": "ADM", "severity": "High", "confidence": 0.5, "excerpt": "x", "explanation": "e", "jurisdictions": ["GDPR"], "evidence": {"line_start": 1, "line_end": 2, "legal_basis": ["A"]}}
    other = {k: v for k, v in (one | change).items() if v is not ...}
    body = json.dumps({"findings": ["text", other, 7, None, [], one], "summary": "s"})
    got = scoring.parse_model_findings(spark.createDataFrame([(1, body)], "doc_id long, body string")).collect()
    assert sorted(r["ord"] for r in got) == [1, 5] if fine else [5]


def test_bodies_that_are_broken_as_a_whole(spark):
    one = '{"category":"ADM","severity":"Low","severity":"High","confidence":0.9,"excerpt":"x","explanation":"e","jurisdictions":["GDPR"],"evidence":{"line_start":1,"line_end":2}}'
    bodies = ['{"findings":[' + one, "[" + one + "]", '{"findings":' + one + "}", '{"findings":null}', "", None, '{"findings":[' + one + "]}"]
    got = scoring.parse_model_findings(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")).collect()
    assert [(r["doc_id"], r["severity"], r["legal_basis"]) for r in got] == [(6, "High", [])]


FIELDS = "doc_id long, ord int, category string, severity string, confidence double, excerpt string, explanation string, jurisdictions array<string>, legal_basis array<string>, line_start int, line_end int, impact int, likelihood int, safeguard_score int, irp_score double, needs_review boolean"


def finding(doc, ord_, category, confidence, excerpt, basis=("A",), codes=("GDPR",), line=1, irp=0.5, safe=0):
    return (doc, ord_, category, "High", confidence, excerpt, "", list(codes), list(basis), line, line, 3, 3, safe, irp, False)


def test_merge_and_filter(spark):
    r = spark.createDataFrame([finding(1, 0, "ADM", 0.9, " same "), finding(1, 1, "adm", 0.8, "SAME"), finding(1, 2, "Minors", 0.9, "y", irp=0.3)], FIELDS)
    m = spark.createDataFrame([finding(1, 0, "ADM", 0.1, "same", safe=2), finding(1, 1, "Other", 0.5, "z"), finding(1, 2, "Bare", 0.9, "b", basis=()), finding(1, 3, "Lost", 0.9, "l", codes=())], FIELDS)
    kept, dropped = scoring.model_finding_filter(m)
    assert [r["dropped"] for r in dropped.collect()] == [1]
    got = {x["category"]: x for x in scoring.merge_findings(r, kept).collect()}
    assert set(got) == {"ADM", "Minors", "Other"}
    assert round(got["ADM"]["confidence"], 6) == 0.58 and got["ADM"]["needs_review"] and got["ADM"]["irp_score"] == 0.42
    assert not got["Minors"]["needs_review"] and got["Minors"]["irp_score"] == 0.3 and got["Other"]["needs_review"] and got["Other"]["from_model"]
    assert scoring.model_finding_filter(m, ["US-CA"])[0].count() == 0


def test_validation_penalties(spark):
    d = docs(spark, "line one\nline two says it", "nothing here", "")
    f = spark.createDataFrame([finding(0, 0, "A", 0.9, "ONE  lime"), finding(0, 1, "B", 0.9, "line two", line=3), finding(0, 2, "C", 0.9, "", basis=(), codes=())], FIELDS)
    got = {r["doc_id"]: r for r in scoring.validation(f, d).collect()}
    # not found; out of range; no excerpt, no place, no basis: 5 issues, 3 flags, 1 uncited, a third covered, and the note on that
    assert got[0]["n_issues"] == 6 and round(got[0]["validation"], 6) == round(0.9 - 0.15 - 0.07 - 0.24 - 0.2 * (0.7 - 1 / 3), 6)
    assert got[0]["issues"][0].startswith("finding 1") and "out of range" in got[0]["issues"][1]
    assert got[1]["n_issues"] == 1 and got[1]["validation"] == 0.0 and got[2]["issues"] == ["no findings"]


def test_document_confidence(spark):
    d = spark.createDataFrame([(0.8, 0.6, True, 2, 0), (0.8, None, False, 0, 0), (0.8, 0.6, True, 0, 3), (0.8, 2.0, True, 1, 9)], "v double, o double, s boolean, n int, x int")
    c = [F.col(k) for k in "vosnx"]
    full = [round(r[0], 6) for r in d.select(scoring.document_confidence(c[0], c[1], False, *c[2:])).collect()]
    assert full == [0.7, 0.64, round(0.7 * 0.85 * 0.7, 6), 0.45]
    assert d.select(scoring.document_confidence(c[0], F.lit(None).cast("double"), True, *c[2:])).first()[0] == pytest.approx(0.68)
    assert [r[0] for r in spark.createDataFrame([(0.8,), (0.79,)], "c double").select(scoring.review_status(F.col("c"))).collect()] == ["completed", "needs_review"]


def test_verdict_falls_back_to_review(spark):
    d = spark.createDataFrame([(["for_work", "for_child"], "Odd"), ([], "Go"), (["odd"], "Stop")], "c array<string>, r string")
    got = [r[0]["label"] for r in d.select(scoring.verdict(F.col("c"), F.col("r"))).collect()]
    w = catalog.VERDICTS
    assert got == [w["for_child"]["Review"][0], w["want_understand"]["Go"][0], w["want_understand"]["Stop"][0]]


def test_action_items(spark):
    f = spark.createDataFrame([(1, "Sale/Share"), (1, "User Rights"), (1, "ADM"), (3, "ADM")], "doc_id long, category string")
    d = spark.createDataFrame([(1, ["US-CA", "GDPR"], ["just_curious", "for_child"]), (2, [], ["for_work"]), (3, [], None)], "doc_id long, codes array<string>, context array<string>")
    got = {r["doc_id"]: r["action_items"] for r in advice.action_items(f, d).collect()}
    a = advice.ADVICE
    assert got[1] == [*a["all"], *a["contexts"]["for_child"], *a["contexts"]["just_curious"]] and got[2] == [] and got[3] == [*a["all"], a["automation"]]


def test_advice_columns(spark):
    d = spark.createDataFrame([("Third Party Sharing", "High"), ("Odd", "Low"), (None, None)], "c string, s string")
    got = [r[0] for r in d.select(advice.action_suggestions(F.col("c"), F.col("s"))).collect()]
    assert got[0][:2] == advice.SEVERE and len(got[0]) == 4 and got[1] == got[2] == advice.OTHERWISE
    e = spark.createDataFrame([("We retain <b>personal data</b> of minors’", ["for_child"]), ("We retain", [])], "t string, c array<string>")
    assert [r[0] for r in e.select(advice.simplify_explanation(F.col("t"), F.col("c"))).collect()] == ["We keep &lt;b&gt;facts about you&lt;/b&gt; of children'", "We retain"]
    j = spark.createDataFrame([(["GDPR", "odd", "GDPR"],)], "j array<string>")
    assert j.select(advice.friendly_jurisdictions(F.col("j"))).first()[0] == ["European Union", "odd"]


def test_spans_prefer_longer_excerpts(spark):
    f = spark.createDataFrame([(0, "ab"), (0, "abcd"), (0, "zz"), (0, "")], "doc_id long, excerpt string")
    got = [(r["start"], r["end"]) for r in advice.highlight_spans(docs(spark, "🙂abcd ab"), f).collect()]
    assert got == [(1, 5), (6, 8)]


def test_analysis_in_full_and_quick(spark):
    d = docs(spark, "We sell data.\nChildren under 13.", "plain words", None).withColumns({"doc_type": F.lit("Privacy Policy"), "industry": F.lit("General"), "context": F.array(F.lit("for_child"))})
    full = {r["doc_id"]: r for r in analysis.analyze(d).collect()}
    quick = {r["doc_id"]: r for r in analysis.analyze(d, quick=True).collect()}
    assert full[0]["n_findings"] == 2 and [f["category"] for f in full[0]["findings"]] == ["Minors", "Sale/Share"]
    assert full[1]["risk_score"] == 0.0 and full[1]["grade"] == "A" and full[1]["confidence"] == 0.0 and full[2]["findings"] is None
    assert quick[0]["n_findings"] == 2 and quick[0]["confidence"] == pytest.approx(0.68) and quick[0]["status"] == "needs_review"
    assert full[0]["top_by_domain"]["Data"] == ["Minors"] and full[0]["verdict_label"].startswith("Child")


def test_cross_references_go_to_later_documents(spark):
    d = spark.createDataFrame([(1, 0, 10, "See our Privacy  Policy, as described in terms; see also cookie policy"), (1, 1, 11, "none"), (1, 2, 12, "governed by our Terms of Service"), (2, 0, 13, "see terms")], "batch long, idx long, doc_id long, text string")
    got = sorted((r["doc_id"], r["target"], r["reference"].lower()) for r in analysis.cross_references(d).collect())
    want = ["as described in terms", "see also cookie policy", "see our privacy  policy"]
    assert got == sorted((10, t, w) for t in (11, 12) for w in want)


# --- reports ------------------------------------------------------------------------------------
def test_reports(spark):
    a = spark.createDataFrame([(1, 4.0, 0.5, "needs_review"), (2, 6.0, 1.0, "completed")], "doc_id long, risk_score double, confidence double, status string")
    row = reports.rubric_scores(a).first()
    assert (row["product_integrity"], row["legal_signal_quality"], row["governance_readiness"]) == (5.0, 7.5, 5.0) and reports.rubric_scores(a.limit(0)).count() == 0
    with pytest.raises(ValueError, match="1 to 200"):
        reports.latest_analyses(a, 0)
    r = spark.createDataFrame([(1, "pending", None, None), (2, "pending", "n", None)], "id long, status string, notes string, updated_at timestamp")
    got = reports.update_reviews(r, spark.createDataFrame([(1, "approved", "ok")], "id long, status string, notes string"), F.current_timestamp())
    assert [(x["id"], x["notes"]) for x in reports.pending_reviews(got).collect()] == [(2, "n")]
    assert reports.remove_items(r, r.filter("id = 1")).count() == 1


def test_portfolio_reads_texts_once(spark, tmp_path):
    """The same rows as by joined scores, an empty cell 0, one scan for the heat map."""
    t = ["We sell data. Automated profiling.", "You have rights; email us. We keep it for 30 days.", "", None, "Children and parents. By continuing you agree.", "as is"]
    rows = [(k, x, k % 3 == 0, ["a", "b", None][k % 3], ["x", "y"][k // 3], k != 5) for k, x in enumerate(t)]
    spark.createDataFrame(rows, "doc_id long, text string, minors boolean, industry string, jurisdiction string, optin boolean").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    told, heat, _ = signals.portfolio(d)
    scores = signals.issue_scores(d)
    top = {r["doc_id"]: r["category"] for r in scoring.top_risks(scores, 1).collect()}
    want = {r["doc_id"]: (r["crs"], r["colour"], r["action"], top[r["doc_id"]]) for r in signals.composite_risk(scores, signals.expected_sections_pct(d)).collect() if r["doc_id"] != 5}
    assert {r["doc_id"]: (r["crs"], r["colour"], r["action"], r["category"]) for r in told.collect()} == want
    got = {(r["industry"], r["jurisdiction"]): (r["mean"], r["n"]) for r in heat.collect()}
    assert len(got) == 6 and got["a", "x"] == (want[0][0], 1) and got[None, "y"] == (0.0, 0)
    assert heat._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_signals_know_ascii_boundaries(spark):
    """As in SQL, a word ends before a letter that isn't ASCII; letters that fold to ASCII count as SQL takes them."""
    import duckdb

    from termlake.plans.more import _m

    texts = [
        "sellóta", "ésold", "sell_x", "sells", "cell sold.", "brokerſ", "\u212aeep", "we \u212aeep it", "chıld", "a child", "sellıng", "WRİTE TO US", "write to us", "as iſ", "3 days", "3 daysé", "<NAME>", "lorem ipsum", "", None,
        "by continuing", "to be decided", "under 13", "under 131",
    ]
    patterns = [*signals.SIGNALS.values(), *signals.SAFEGUARDS.values(), signals.OPEN_END, *(p for p, _ in signals.OBSERVED.values()), *signals.EXPECTED, signals.RIGHTS_WORDS, *(h[3] for h in signals.HEURISTICS if h[3])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in signals._scanned(d).select("doc_id", *[signals._has(p).alias(f"p{k}") for k, p in enumerate(patterns)]).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"SELECT {', '.join(f'coalesce({_m(p)}, false)' for p in patterns)} FROM t ORDER BY i").fetchall()
    assert got == want
    assert got[0][list(patterns).index(signals.SIGNALS["SaleShare"])]


def test_public_urls(spark):
    urls = ["https://example.com/a", "http://10.1.2.3/", "http://172.31.0.1", "http://172.32.0.1", "ftp://example.com", "http://localhost/", "http://[::1]/", "nope", None, "http://192.168.0.9:80/x"]
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in d.select(text.public_url(F.col("u"))).collect()] == [True, False, False, True, False, False, False, False, False, False]


def test_signals(spark):
    d = docs(spark, "We retain data for 30 days. Automated decisions; ask for a review. Contact us.", "").withColumn("minors", F.lit(True))
    s = {(r["doc_id"], r["category"]): (r["impact"], r["likelihood"], r["safeguard"]) for r in signals.issue_scores(d).collect()}
    assert s[0, "Retention"] == (2, 4, 4) and s[0, "ADM"] == (5, 5, 4) and s[1, "Minors"] == (5, 5, 1) and s[1, "Dark"] == (3, 0, 1)
    assert [r["observation"] for r in signals.observations(d).filter("doc_id = 0").collect()] == ["no word on minors"]
    assert signals.expected_sections_pct(d).filter("doc_id = 0").first()["percent"] == 50
    e = signals.absence_findings(d).filter("doc_id = 1").collect()
    assert [(r["category"], r["excerpt"]) for r in e] == [("Missing Rights", "")]
    assert signals.absence_summary(signals.absence_findings(d)).filter("doc_id = 1").first()["n_rights"] == 4


def test_pooled_and_multiclass_agreement(spark):
    none = spark.createDataFrame([], "doc_id long, category string")
    assert rollups.kappa_pooled(rollups.confusion(none, none, docs(spark, "a"), ["X"])).first()["kappa"] == 1.0
    p = spark.createDataFrame([("c", "R", "R"), ("c", "Y", "G"), ("c", "G", "G"), ("d", "R", "R")], "category string, gold string, predicted string")
    got = {r["category"]: r for r in rollups.multiclass(p).collect()}
    assert got["c"]["macro_f1"] == pytest.approx((1 + 0 + 2 / 3) / 3) and got["c"]["kappa"] == pytest.approx((2 / 3 - 3 / 9) / (1 - 3 / 9)) and got["d"]["kappa"] == 0.0


# --- versions, watch, streams -------------------------------------------------------------------
def test_line_and_token_differences(spark):
    p = spark.createDataFrame([("u", 1, "a\nb\nc", "a\nB\nc\n\nd"), ("u", 2, "x", "x"), ("u", 3, None, "new line")], "url string, version int, old_text string, text string")
    got = {r["version"]: (r["change_count"], r["summary"]) for r in versions.line_diff(p).collect()}
    assert got[1] == (4, "--- \n+++ \n-b\n+B\n+d")  # the headers take two of the lines
    assert got[2] == (0, "") and got[3][0] == 1
    t = versions.token_diff(p)
    assert [(r["token"], r["type"], r["line"]) for r in t.filter("version = 1").orderBy("n").collect()] == [("b", "removed", 2), ("B", "added", 2), ("d", "added", 5)]
    s = {r["version"]: r for r in versions.diff_severity_summary(t).collect()}
    assert s[1]["change_count"] == 3 and s[1]["low"] == 3 and 2 not in s
    with pytest.raises(Exception, match="two urls"):
        versions.snapshot_pair(spark.createDataFrame([(1, "u", "a")], "pair int, url string, text string"), spark.createDataFrame([(1, "v", "b")], "pair int, url string, text string")).collect()


WATCH = "id long, source_url string, enabled boolean, check_frequency int, last_checked timestamp, status string, changes_since timestamp, change_count int, change_summary string, last_hash string, risk_delta double, last_risk double, last_text string"


def test_watch_round(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    w = spark.createDataFrame([(i, u, on, every, None, "New", None, 0, "", h, 0.0, r, "old\nsame") for i, u, on, every, h, r in [(1, "a", True, 60, "x", 3.0), (2, "b", True, 60, None, None), (3, "c", False, 60, "x", 1.0), (4, "d", None, None, "x", 1.0), (5, "e", True, 60, "x", 1.0), (6, "a", True, 60, "x", 1.0)]], WATCH)
    f = spark.createDataFrame([("a", "new\nsame", True, 5.0), ("a", "new\nsame", True, 5.0), ("b", "t", True, 2.0), ("e", None, False, None)], "url string, text string, ok boolean, risk double")
    got = {r["id"]: r for r in versions.watch_refresh(w, f, now).collect()}
    assert len(got) == 6 and versions.watch_refresh(w, f, now).count() == 6
    assert (got[1]["status"], got[1]["change_count"], got[1]["risk_delta"]) == ("Updated", 2, 2.0) and "+new" in got[1]["change_summary"] and got[1]["changes_since"] is not None
    assert (got[2]["status"], got[2]["risk_delta"], got[2]["change_summary"]) == ("No Changes", 0.0, "")
    assert got[3]["status"] == "New" and got[4]["status"] == "New" and got[5]["status"] == "Check Failed" and got[5]["last_hash"] == "x"
    assert {r["id"] for r in versions.due_items(w, now, 60).collect()} == {1, 2, 4, 5, 6}


def test_legacy_watch_counts(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    old = spark.createDataFrame([(1, "http://A.com/x", "u1", 0, "true"), (2, "http://A.com/x", "u2", 600, "off"), (3, "http://b.com", None, 0, None), (4, "", "u", 1, "1"), (5, None, "u", 1, "1"), (6, "c", "u6", 0, "odd")], "id long, url string, user_id string, check_frequency int, enabled string").withColumn("created_at", F.lit(None).cast("timestamp"))
    now_watched = spark.createDataFrame([(9, "V", "http://A.com/x", "No Changes", None, 86400, True)], "id long, vendor string, source_url string, status string, user_id string, check_frequency int, enabled boolean").withColumn("created_at", F.lit(None).cast("timestamp"))
    merged, counts = versions.merge_legacy_watch(old, now_watched, now)
    got = {r["source_url"]: (r["vendor"], r["user_id"], r["check_frequency"], r["enabled"]) for r in merged.collect()}
    assert got == {"http://A.com/x": ("V", "u1", 600, False), "http://b.com": ("b.com", None, 86400, True), "c": ("Unknown vendor", "u6", 86400, False)}
    assert tuple(counts.first()) == (1, 2, 2)


def test_significant_changes(spark):
    v = spark.createDataFrame([("u", 1, 0, 5.0, 4.5), ("u", 2, 1, 6.5, 5.0), ("u", 3, 2, 6.5, 6.5)], "url string, version int, old_version int, risk double, old_risk double")
    f = spark.createDataFrame([("u", 0, "A", "High"), ("u", 1, "A", "High"), ("u", 3, "B", "High"), ("u", 1, "C", "Low")], "url string, version int, category string, severity string")
    assert sorted((r["version"], r["delta"], r["n_new_high"]) for r in versions.significant_changes(v, f).collect()) == [(2, 1.5, 0), (3, 0.0, 1)]


def test_stream_watch_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(f"u{k % 3}", k // 3, f"2024-01-0{k // 3 + 1} 00:00:00", f"text {k % 3} {k // 6}", float(k % 5)) for k in range(12)]
    table = spark.createDataFrame(rows, "url string, version int, at string, text string, risk double").withColumn("captured_at", F.col("at").cast("timestamp")).drop("at")
    for part in (0, 1):
        table.filter(F.floor(F.col("version") / 2) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    try:
        q = streams.stream_watch(s).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    except Exception as e:  # the state processor needs protobuf, which a session may lack
        pytest.skip(str(e)[:80])
    try:
        q.awaitTermination(120)
    except Exception as e:
        if "protobuf" in str(e):
            pytest.skip("no protobuf")
        raise
    got = sorted((r["url"], r["version"], r["status"], r["risk_delta"]) for r in spark.table("watched").collect())
    want, last = [], {}
    for url, version, _, words, risk in sorted(rows):
        old = last.get(url)
        want.append((url, version, "Updated" if old and old[0] != words else "No Changes", round(risk - old[1], 2) if old else 0.0))
        last[url] = (words, risk)
    assert got == sorted(want)


def test_only_changed_parts_are_compared(spark):
    """Random edits, moves and repeats: the same differences as of whole texts, from a small part of them."""
    rng, rows = random.Random(8), []
    for k in range(40):
        words = [f"w{rng.randint(0, 60)}" + rng.choice(["", ",", ".", "'s", "é"]) for _ in range(rng.choice([0, 3, 900]))]
        new = list(words)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(new))
            new[at : at + rng.randint(0, 2)] = [f"x{rng.randint(0, 9)};"] * rng.randint(0, 2)
        if k % 5 == 0:
            new = new[200:] + new[:200]
        rows.append((f"u{k}", 1, " ".join(words), None if k == 7 else " ".join(new).replace("w7 ", "w7\n")))
    pairs = spark.createDataFrame(rows, "url string, version int, old_text string, text string")
    want = {}
    for url, _, old, new in rows:
        bags = [collections.Counter(re.findall(versions.TOKEN, t or "")) for t in (old, new)]
        want |= {(url, t): bags[1][t] - bags[0][t] for t in bags[0] | bags[1] if bags[1][t] != bags[0][t]}
    assert {(r["url"], r["token"]): r["delta"] for r in versions.token_bag_diff(pairs).collect()} == want
    moved = [(f"u{k}", 1, " ".join(f"t{i * 7919 % 5000}" for i in range(3000)), " ".join([f"t{i * 7919 % 5000}" for i in range(1500, 3000)] + ["new"] + [f"t{i * 7919 % 5000}" for i in range(1500)])) for k in range(3)]
    parts = versions.changed_parts(spark.createDataFrame(moved, pairs.schema)).collect()
    assert len(parts) == 3 and all(len(r["new_part"]) + len(r["old_part"]) < 0.1 * len(moved[0][2]) for r in parts)


def test_stream_snapshots_never_repeat(spark, tmp_path):
    rows = [("u", 0, "2024-01-01", "a"), ("u", 1, "2024-01-02", "b"), ("u", 2, "2024-01-03", "a"), ("v", 0, "2024-01-01", "a")]
    table = spark.createDataFrame(rows, "url string, version int, captured_at string, text string")
    store = str(tmp_path / "store")
    for n in range(2):
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.stream_snapshots(s, store, str(tmp_path / "c")).start().awaitTermination(120)
        assert spark.read.parquet(store).count() == 3, n


def test_windows_over_a_stream_drop_late_rows(spark, tmp_path):
    first = [("2024-01-01 00:10:00", 0.5, "a"), ("2024-01-01 00:50:00", 1.0, "a"), ("2024-01-01 05:00:00", 0.0, "b")]
    late = [("2024-01-01 00:20:00", 0.9, "a"), ("2024-01-01 09:00:00", 0.2, "b")]
    schema = "at string, crs double, industry string"
    for k, rows in enumerate((first, late)):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05 * k)
    df = spark.read.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = streams.stream_kpis(s, "1 hour", "1 hour").writeStream.format("memory").queryName("kpis").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r["start"]): (r["n"], r["mean"]) for r in spark.table("kpis").collect()}
    assert got["2024-01-01 00:00:00"][0] in (2, 3) and got["2024-01-01 05:00:00"] == (1, 0.0)
    slide = {str(r["start"]): r["n"] for r in streams.stream_kpis(df, "2 hours", slide="1 hour").collect()}
    assert slide["2024-01-01 00:00:00"] == 3 and slide["2023-12-31 23:00:00"] == 3
    assert sorted((r["industry"], r["n"]) for r in streams.stream_sessions(df, "35 minutes").collect()) == [("a", 3), ("b", 1), ("b", 1)]


# --- retrieval, sources -------------------------------------------------------------------------
def test_retrieval_pools(spark):
    c = spark.createDataFrame([(1, "sell data", "gdpr", [1.0, 0.0]), (2, "keep data", "GDPR", [0.0, 1.0]), (3, "sell sell", "US-CA", [1.0, 0.0]), (4, None, None, None)], "chunk_id long, text string, jurisdiction string, vector array<double>")
    q = spark.createDataFrame([(1, "sell", ["gdpr"], [2.0, 0.0]), (2, "sell", ["nowhere"], [1.0, 0.0]), (3, "sell", None, [0.0, 0.0]), (4, "", [], [1.0, 1.0])], "query_id long, text string, codes array<string>, vector array<double>")
    got = {}
    for r in retrieval.retrieve(q, c, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got[1] == [1, 2] and set(got[2]) == {1, 3, 2} and 3 not in got and len(got[4]) == 3
    with pytest.raises(ValueError, match="at most"):
        retrieval.Ranker(c, q, most_queries=2)


def test_own_bm25_within_the_row(spark):
    """As by shuffled words, with words of negative weight, repeats, and chunks without any word; nothing is shuffled."""
    corpora = {1: ["a a b", "a c", "", "a d d", "x"], 2: ["a", "a b", "a c", "a"], 3: [""], 4: ["q q", None, "a"], 5: []}
    d = spark.createDataFrame([(k, c, "a B d a") for k, c in corpora.items()], "corpus long, chunks array<string>, query string")
    scored = retrieval.with_own_bm25(d, "chunks", "query")
    got = {(r["corpus"], k): x for r in scored.collect() for k, x in enumerate(r["bm25"]) if x is not None}
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    pool = spark.createDataFrame([(k, i, t or "") for k, c in corpora.items() for i, t in enumerate(c)], "corpus long, chunk_id long, text string")
    want = {(r["corpus"], r["chunk_id"]): r["score"] for r in retrieval.bm25(d.selectExpr("corpus", "0 AS query_id", "query AS text"), pool).collect()}
    assert got.keys() == want.keys() and len(got) == 8 and min(got.values()) < 0
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_relevant_chunks(spark):
    long = "\n".join(f"line {k} " + ("rights " if k == 40 else "word ") * 20 for k in range(60))
    d = docs(spark, "short", long)
    cut = text.chunk_text(d)
    v = cut.select("doc_id", "n", F.array(F.col("chunk").contains("rights").cast("double")).alias("world"), F.lit(None).cast("array<double>").alias("eu"))
    got = {r["doc_id"]: r["text"] for r in retrieval.select_relevant_chunks(d, "rights", v, {"world": [1.0]}, 2000).collect()}
    assert got[0] == "short" and "rights" in got[1] and len(got[1]) < 2100
    # the chunks are brought together once, and so are the vectors' scores
    plan = retrieval.select_relevant_chunks(d, "rights", v, {"world": [1.0]}, 2000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    assert retrieval.select_relevant_chunks(d, "rights", None, None, 100).filter("doc_id = 1").first()["text"] == long[:100]


def test_bundles_and_chunks(spark, tmp_path):
    c = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "chunk_id long, vector array<float>")
    m = lambda *x: spark.createDataFrame([x], "version string, chunks_version string, vectors_version string, n_chunks long, size int")
    reasons = [retrieval.bundle_guard(c, x, y).first()["reason"] for x, y in ((v, m("1", "1", "1", 2, 2)), (v, m("1", "2", "1", 2, 2)), (v, m("1", "1", "1", 3, 2)), (v, m("1", "1", "1", 2, 3)), (v.withColumn("chunk_id", F.col("chunk_id") + 1), m("1", "1", "1", 2, 2)))]
    assert reasons == [None, "versions differ", "counts differ", "vector sizes differ", "chunks without vectors"]
    texts = c.select("chunk_id", F.lit("some words").alias("text"), F.lit("GDPR").alias("jurisdiction"))
    assert retrieval.build_corpus_index(texts, v, str(tmp_path / "index")).n == 1


def test_corpus_files(spark, tmp_path):
    (tmp_path / "us-co").mkdir()
    (tmp_path / "us-co" / "law.txt").write_text("# Status: Placeholder\n# Title: Law\npreamble\n## One\nfirst\n## Two\nsecond\n")
    (tmp_path / "us-co" / "flat.txt").write_text("# Status: final\njust text\n")
    s = readers.read_corpus(spark, str(tmp_path))
    rows = sorted((r["law"], r["section"], r["text"]) for r in s.collect())
    assert rows == [("flat", "", "just text"), ("law", "One", "first"), ("law", "Two", "second")]
    chunks = retrieval.quality_flags(text.section_chunks(s))
    assert sorted((r["text"], r["placeholder"]) for r in chunks.collect()) == [("One\nfirst", True), ("Two\nsecond", True), ("just text", False)]


def test_files_of_any_kind(spark, tmp_path):
    for name, raw in {"a.txt": "é".encode(), "b.html": b"<p>x</p><script>y</script><p>z</p>", "c.pdf": b"%PDF", "d.bin": b"<!doctype html><b>q</b>", "e.md": "ü".encode("utf-16"), "f.txt": b"\xff"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rpartition("/")[2]: (r["text"], r["reason"]) for r in readers.read_binary_docs(spark, str(tmp_path / "*")).collect()}
    assert got == {"a.txt": ("é", None), "b.html": ("x\nz", None), "c.pdf": (None, "no reader for pdf"), "d.bin": ("q", None), "e.md": ("ü", None), "f.txt": ("ÿ", None)}
    (tmp_path / "x.csv").write_text("name,url\na,b\n")
    with pytest.raises(ValueError, match="jurisdiction"):
        readers.read_batch_csv(spark, str(tmp_path / "x.csv"))


def test_places_models_and_batches(spark):
    d = spark.createDataFrame([("United States", "Texas"), ("United States", "Mars"), ("France", None), ("Atlantis", "x"), (None, None)], "c string, s string")
    assert [r[0] for r in d.select(reports.location_to_jurisdictions(F.col("c"), F.col("s"))).collect()] == [["US-TX", "US-FED"], ["US-FED"], ["GDPR"], [], []]
    b = spark.createDataFrame([(1, 0, " B "), (1, 1, "A"), (1, 2, "B"), (2, 0, " "), (3, 0, None)], "batch int, idx int, jurisdiction string")
    assert {r["batch"]: r["codes"] for r in reports.batch_jurisdictions(b).collect()} == {1: ["B", "A"], 2: [], 3: []}


def test_exports_read_back(spark, tmp_path):
    d = docs(spark, 'a "quoted", cell', "two").withColumn("name", F.lit("n"))
    for kind in ("csv", "json", "parquet"):
        readers.write_rows(d, str(tmp_path / kind), kind)
        readers.write_rows(d, str(tmp_path / kind), kind, "append")
        back = spark.read.option("header", True).option("escape", '"').format(kind).load(str(tmp_path / kind))
        assert sorted(r["text"] for r in back.collect()) == sorted(2 * ['a "quoted", cell', "two"])
    assert readers.read_documents(spark, str(tmp_path / "parquet")).count() == 4
    with pytest.raises(ValueError, match="no writer"):
        readers.write_rows(d, str(tmp_path / "x"), "pdf")


def test_prompts_hold_findings_passages_and_numbered_text(spark):
    f = spark.createDataFrame([(0, 1, "ADM", "High", "second"), (0, 0, "Sale", "Low", "first")], "doc_id long, ord int, category string, severity string, excerpt string")
    p = spark.createDataFrame([(0, 2, "Law", "2", "b", True), (0, 1, "Act", "1", "a", False)], "doc_id long, rank int, law string, section string, text string, placeholder boolean")
    got = {r["doc_id"]: r["prompt"] for r in reports.prompt_rows(docs(spark, "x\ny", None), f, p).collect()}
    assert got[0] == "Findings:\n- Sale (Low): first\n- ADM (High): second\nLaw:\n[Act, 1] a\n[UNVERIFIED Law, 2] b\nText:\n0001| x\n0002| y"
    assert got[1].startswith("Findings:\nnone\nLaw:\nnone\n")
