"""Registered queries of analyses, advice, reports, portfolios and versions, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog, text
from ..operators import advice, analysis, reports, retrieval, rollups, rules, scoring, signals, versions
from ..streaming import streams
from . import policies as views
from .policies import _q
from .queries import ORACLE_SQL, QUERIES, _CHIP, _FINDINGS, _MERGED, _READY, _SCORES, _SECTIONED, _TOKENS, _WEIGHT, _asked, _boosted, _case, _chunks, _gold, _validation, _verdict, query

__all__ = ["QUERIES", "ORACLE_SQL"]
_ANALYSES = f"WITH {views.SQL_ANALYSES}"
_RANK = {s: k for k, s in enumerate(catalog.SEVERITIES, 1)}


# --- projections and filters --------------------------------------------------------------------
@query("SELECT doc_id, substr(coalesce(text, ''), 1, 50000) AS kept FROM documents")
def p1_truncate(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.truncate_text(F.coalesce("text", F.lit(""))).alias("kept"))


@query(f"WITH {views.SQL_MODEL}, k AS (SELECT doc_id, ord, 0 AS dropped FROM model WHERE len(legal_basis) > 0 AND len(jurisdictions) > 0 AND list_has_any(jurisdictions, ['GDPR', 'US-CA'])) SELECT doc_id, ord::BIGINT AS ord, 0 AS dropped FROM k UNION ALL SELECT doc_id, -1, count(*) FROM model WHERE len(legal_basis) = 0 GROUP BY doc_id")
def p4_model_filter(spark, d):
    kept, dropped = scoring.model_finding_filter(views.model_findings(spark, d), ["GDPR", "US-CA"])
    return kept.select("doc_id", F.col("ord").cast("long").alias("ord"), F.lit(0).cast("long").alias("dropped")).unionByName(dropped.select("doc_id", F.lit(-1).cast("long").alias("ord"), "dropped"))


_CSV = ["GDPR, US-CA", "nowhere,GDPR", "", " US-FED ,x", "UK-GDPR"]


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({views.sql_pick(_CSV, 'doc_id')}, ','), lambda x: trim(x)), lambda x: x IN ('GDPR', 'US-CA', 'US-FED')), ',') AS codes FROM documents")
def p5_codes(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.array_join(text.sanitize_codes(views.pick(_CSV, F.col("doc_id")), ["GDPR", "US-CA", "US-FED"]), ",").alias("codes"))


_HOSTS = ["10.0.0.", "11.0.0.", "172.16.9.", "172.32.9.", "192.168.1.", "8.8.8.", "100.64.0.", "127.0.0.", "example", "169.254.1."]


@query(f"SELECT doc_id, doc_id % 7 <> 0 AND {views.sql_pick(['', 'x', '', 'x', '', 'x', '', '', 'x', ''], 'doc_id')} = 'x' AS public FROM documents")
def p7_public_url(spark, d):
    i = F.col("doc_id")
    url = F.concat(F.when(i % 7 == 0, "ftp://").otherwise("https://"), views.pick(_HOSTS, i), F.when(i % 10 == 8, ".com").otherwise((i % 250).cast("string")), F.lit("/terms"))
    return views.table(spark, d, "documents").select("doc_id", text.public_url(url).alias("public"))


@query(f"WITH {_FINDINGS} SELECT doc_id, ord FROM findings WHERE category = 'Minors' AND severity = 'High'")
def p8_filter_findings(spark, d):
    return reports.filter_findings(rules.rule_hits(views.policies(spark, d)), "Minors", "High").select("doc_id", "ord")


@query(f"WITH {views.SQL_ROLLUPS} SELECT industry, jurisdiction, count(*) AS n FROM rollups WHERE industry = 'Finance' GROUP BY 1, 2")
def p9_filter_rollups(spark, d):
    return reports.filter_rollups(views.rollups(spark, d), industry="Finance", jurisdiction="All").groupBy("industry", "jurisdiction").agg(F.count("*").alias("n"))


@query(f"{_ANALYSES} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'fine' END AS notes FROM analyses WHERE status = 'needs_review' AND doc_id % 5 <> 0")
def p10_pending_reviews(spark, d):
    """Reviews of which one in five was decided; those that are left."""
    none = F.lit(None)
    r = views.analyses(spark, d).filter("status = 'needs_review'").select(F.col("doc_id").alias("id"), F.lit("pending").alias("status"), none.cast("string").alias("notes"), none.cast("timestamp").alias("updated_at"))
    decided = views.table(spark, d, "documents").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.lit("approved").alias("status"), F.lit("fine").alias("notes"))
    return reports.pending_reviews(reports.update_reviews(r, decided, F.current_timestamp())).select(F.col("id").alias("doc_id"), "status", "notes")


@query(f"{_ANALYSES} SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'fine' END AS notes, doc_id % 5 = 0 AS updated FROM analyses WHERE status = 'needs_review'")
def j10_update_reviews(spark, d):
    none = F.lit(None)
    r = views.analyses(spark, d).filter("status = 'needs_review'").select(F.col("doc_id").alias("id"), F.lit("pending").alias("status"), none.cast("string").alias("notes"), none.cast("timestamp").alias("updated_at"))
    decided = views.table(spark, d, "documents").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.lit("approved").alias("status"), F.lit("fine").alias("notes"))
    return reports.update_reviews(r, decided, F.current_timestamp()).select("id", "status", "notes", F.col("updated_at").isNotNull().alias("updated"))


@query(f"{_ANALYSES} SELECT doc_id, name, vendor, length(text)::INTEGER AS had, NULL::VARCHAR AS document_text FROM analyses JOIN documents USING (doc_id)")
def p12_redact(spark, d):
    """Stored analyses with their texts, which are not given out."""
    stored = views.analyses(spark, d).join(views.table(spark, d, "documents").select("doc_id", F.col("text").alias("document_text"), F.length("text").alias("had")), "doc_id")
    return reports.redact_document_text(stored).select("doc_id", "name", "vendor", "had", "document_text")


_PLACES = [("United States", "California"), ("United States", "Nowhere"), ("Germany", "Bavaria"), ("Atlantis", ""), ("Canada", "Quebec")]


@query(f"SELECT doc_id, {views.sql_pick(['US-CA,US-FED', 'US-FED', 'GDPR', '', 'PIPEDA'], 'doc_id')} AS codes FROM documents")
def p13_location(spark, d):
    i = F.col("doc_id")
    codes = reports.location_to_jurisdictions(views.pick([c for c, _ in _PLACES], i), views.pick([s for _, s in _PLACES], i))
    return views.table(spark, d, "documents").select("doc_id", F.array_join(codes, ",").alias("codes"))


@query(f"SELECT doc_id, CASE WHEN lower(lang) IN ({', '.join(map(_q, reports.EU_LANGUAGES))}) THEN 'eu' ELSE 'world' END AS model FROM documents")
def p14_route_model(spark, d):
    return views.table(spark, d, "documents").select("doc_id", reports.route_model(F.col("lang")).alias("model"))


# --- rules --------------------------------------------------------------------------------------
_WIDE = catalog.wide_rules()
_SAID = "concat_ws(chr(10), text, " + ", ".join(f"CASE WHEN (doc_id * 7 + {k * 13}) % 61 < 3 THEN {_q(r.example)} END" for k, r in enumerate(_WIDE)) + ")"


@query(f"WITH {views.SQL_POLICIES}, wide AS (SELECT doc_id, {_SAID} AS text FROM policies), q AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS ord, {j} AS j, len(regexp_extract_all(text, {_q('(?i)' + p)})) AS n FROM wide" for k, r in enumerate(_WIDE) for j, p in enumerate(r.patterns)) + ") SELECT doc_id, ord, count(*)::INT AS hits, sum(n)::INT AS matches FROM q WHERE n > 0 GROUP BY 1, 2")
def m2_wide_catalogue(spark, d):
    """A catalogue of 240 patterns over whole texts, with sentences it finds in some of them."""
    said = [F.when(F.pmod(F.col("doc_id") * 7 + k * 13, F.lit(61)) < 3, r.example) for k, r in enumerate(_WIDE)]
    wide = views.policies(spark, d).select("doc_id", F.concat_ws("\n", "text", *said).alias("text"))
    return rules.rule_hits(wide, _WIDE).select("doc_id", "ord", "hits", "matches")


@query(f"WITH {_FINDINGS} SELECT DISTINCT category FROM findings WHERE category NOT IN ({', '.join(map(_q, sorted(catalog.IRP)))})")
def j13_catalog_guard(spark, d):
    """Categories in use without seeded impact."""
    known = spark.createDataFrame([(c,) for c in sorted(catalog.IRP)], "category string")
    return reports.catalog_guard(rules.rule_hits(views.policies(spark, d)), known)


@query(f"""WITH {views.SQL_MODEL}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS place, (doc_id * 5 + ord) % 13 AS way FROM model)
SELECT doc_id, place::INTEGER AS ord, category, severity, confidence::DOUBLE AS confidence, excerpt, CASE WHEN way = 4 THEN 4 ELSE 3 END::INTEGER AS impact, CASE WHEN way = 4 THEN 0.58 ELSE 0.48 END::DOUBLE AS irp_score,
  confidence < 0.6 AS needs_review, array_to_string(jurisdictions, ',') AS jurisdictions, array_to_string(legal_basis, ',') AS legal_basis, line_start::INTEGER AS line_start
FROM p WHERE way NOT IN (0, 1, 2, 3, 6, 7, 8) AND doc_id % 17 <> 0 AND doc_id % 19 <> 0""")
def j2_parse_model(spark, d):
    """Bodies with malformed items of nine kinds, some broken as a whole."""
    f = scoring.parse_model_findings(views.model_bodies(spark, d))
    both = [F.array_join(c, ",").alias(c) for c in ("jurisdictions", "legal_basis")]
    return f.select("doc_id", "ord", "category", "severity", "confidence", "excerpt", "impact", F.round("irp_score", 4).alias("irp_score"), "needs_review", *both, "line_start")


# --- whole analyses -----------------------------------------------------------------------------
def _analysed(source: str, quick: bool = False) -> str:
    """The analysis of the findings of `source`, up to the verdict."""
    sure = "0.85 * validation" if quick else (
        "greatest(0, least(1, (validation + (doc_id * 37 % 100) / 100.0) / 2 * CASE WHEN doc_id % 4 = 0 THEN 0.8 WHEN n_model = 0 THEN 0.85 ELSE 1.0 END * CASE WHEN dropped > 0 THEN greatest(0.5, 1 - 0.1 * dropped) ELSE 1.0 END))"
    )
    return f"""{_SECTIONED}, {_validation(source)},
weighed AS (SELECT f.*, ['Low', 'Medium', 'High', 'Critical'][least(4, least(4, {_case(_RANK, 'severity', '0')} + {_boosted(catalog.DOC_TYPE_BOOSTS, 'doc_type')}) + {_boosted(catalog.INDUSTRY_BOOSTS, 'industry')})] AS level, context FROM {source} f JOIN policies USING (doc_id)),
total AS (SELECT doc_id, coalesce(round_even(sum(irp_score::DECIMAL(10, 6))::DOUBLE / count(irp_score) * 10, 2), 0.0)::DOUBLE AS risk_score, count(category) AS n_findings, count(*) FILTER (level = 'Critical') AS n_critical, count(*) FILTER (level = 'High') AS n_high, count(*) FILTER (level = 'Medium') AS n_medium FROM policies LEFT JOIN weighed USING (doc_id) GROUP BY doc_id),
said AS (SELECT doc_id, count(*) FILTER (len(legal_basis) > 0 AND len(jurisdictions) > 0) AS n_model, count(*) FILTER (len(legal_basis) = 0) AS dropped FROM policies LEFT JOIN model USING (doc_id) GROUP BY doc_id),
scored AS (SELECT *, {sure} AS confidence FROM total JOIN sectioned USING (doc_id) JOIN validated USING (doc_id) JOIN said USING (doc_id)),
judged AS (SELECT *, {_READY} FROM scored), chipped AS (SELECT *, {_CHIP} FROM judged)"""


_GRADE = "CASE " + " ".join(f"WHEN risk_score >= {b} THEN {_q(g)}" for b, g in catalog.GRADES) + " ELSE 'A' END"
_OUT = f"""SELECT doc_id, CASE WHEN confidence < 0.8 THEN 'needs_review' ELSE 'completed' END AS status, round(confidence, 6) AS confidence, risk_score, {_GRADE} AS grade, completeness, readiness, {_verdict(0)} AS label, {_verdict(1)} AS headline,
  n_findings, n_critical, n_high, n_medium, n_issues FROM chipped"""


def _columns(a):
    return a.select("doc_id", "status", F.round("confidence", 6).alias("confidence"), "risk_score", "grade", "completeness", F.col("action_readiness").alias("readiness"), F.col("verdict_label").alias("label"), F.col("verdict_headline").alias("headline"), "n_findings", "n_critical", "n_high", "n_medium", "n_issues")


def _full(spark, d):
    return analysis.analyze(views.policies(spark, d), views.model_findings(spark, d), views.model_answers(spark, d))


@query(f"WITH {_FINDINGS}, {_MERGED}, {_analysed('merged')} {_OUT}")
def e1_analyze(spark, d):
    return _columns(_full(spark, d))


_SIZES = "list_transform({}, lambda x: length(x))"
_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_QUICK = "q AS (" + " UNION ALL ".join(
    f"SELECT doc_id, text, {k} AS ord, {j} AS pattern, string_split_regex(text, {_q('(?im)' + p)}) AS pieces, regexp_extract_all(text, {_q('(?im)' + p)}) AS hits FROM policies"
    for k, r in enumerate(catalog.RULES) if r.severity in ("High", "Critical") for j, p in enumerate(r.patterns)) + f"""),
spot AS (SELECT doc_id, text, ord, pattern, i, (coalesce(list_sum({_SIZES.format('pieces[1:i]')}), 0) + coalesce(list_sum({_SIZES.format('hits[1:i - 1]')}), 0))::BIGINT AS start, length(hits[i]) AS size FROM q, unnest(range(1, len(hits) + 1)) AS t(i)),
every AS (SELECT doc_id, ord, pattern, i, category, severity, jurisdictions, legal_basis, 0.8 AS confidence, round(0.5 * (impact / 5.0) + 0.4 * (likelihood / 5.0), 4)::DOUBLE AS irp_score,
  {_TRIM("substr(text, greatest(0, start - 50) + 1, start + size + 50 - greatest(0, start - 50))")} AS excerpt, length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1 AS line_start,
  length(substr(text, 1, start + size)) - length(replace(substr(text, 1, start + size), chr(10), '')) + 1 AS line_end FROM spot JOIN rules USING (ord)),
quick AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, lower(category), lower(substr(trim(excerpt), 1, 120)) ORDER BY ord, pattern, i) = 1)"""


@query(f"WITH {_FINDINGS}, {views.SQL_MODEL}, {_QUICK}, {_analysed('quick', True)} {_OUT}")
def e1_quick(spark, d):
    return _columns(analysis.analyze(views.policies(spark, d), quick=True))


@query(f"""WITH {_FINDINGS}, {_MERGED}, {_analysed('merged')},
placed AS (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN {_WEIGHT} > 0 THEN {_WEIGHT} ELSE 1.0 END DESC, irp_score DESC, {_case(_RANK, 'level', '0')} DESC, from_model, ord) AS place FROM weighed)
SELECT doc_id, category, place::INT AS place FROM placed""")
def e1_findings(spark, d):
    """The findings of whole analyses in the order in which they are shown."""
    return analysis.merged_findings(views.policies(spark, d), views.model_findings(spark, d)).select("doc_id", "category", "place")


def _batches(spark, d):
    i = F.col("doc_id")
    return views.policies(spark, d).withColumns({"batch": F.floor(i / 20), "idx": i % 20, "name": F.when(i % 3 == 0, F.concat(F.lit("policy "), i.cast("string"))), "url": F.when(i % 3 != 2, F.col("url"))})


@query(f"""WITH {_FINDINGS}, {_MERGED}, {_analysed('merged')}
SELECT doc_id, doc_id // 20 AS batch, CASE WHEN doc_id % 3 = 0 THEN 'policy ' || doc_id WHEN doc_id % 3 = 1 THEN url ELSE 'Document ' || (doc_id % 20 + 1) END AS name, n_findings, risk_score FROM chipped JOIN policies USING (doc_id)""")
def e2_batch(spark, d):
    done, _ = analysis.analyze_batch(_batches(spark, d), model=views.model_findings(spark, d), answers=views.model_answers(spark, d))
    return done.select("doc_id", "batch", "name", "n_findings", "risk_score")


@query(f"WITH {_FINDINGS}, {_MERGED}, {_analysed('merged')} SELECT doc_id, status AS stored, substr(text, 1, 50000) AS document_text, confidence < 0.8 AS review FROM (SELECT *, CASE WHEN confidence < 0.8 THEN 'needs_review' ELSE 'completed' END AS status FROM chipped) JOIN policies USING (doc_id)")
def s13_persist(spark, d):
    """What is stored of each analysis, and whether a review is opened."""
    a = _full(spark, d)
    rows, reviews = analysis.stored(a, views.policies(spark, d))
    return rows.join(reviews.select(F.col("analysis_id").alias("doc_id"), F.lit(True).alias("review")), "doc_id", "left").select("doc_id", F.col("status").alias("stored"), "document_text", F.coalesce("review", F.lit(False)).alias("review"))


# --- advice -------------------------------------------------------------------------------------
def _flag(kind: str) -> str:
    return f"coalesce(bool_or(category IN ({', '.join(map(_q, advice.ADVICE_FOR[kind]))})), false) AS {kind}"


_A = advice.ADVICE
_LINES = ", ".join(
    [*map(_q, _A["all"])] + [f"CASE WHEN list_contains(context, {_q(c)}) THEN {_q(x)} END" for c, own in _A["contexts"].items() for x in own]
    + [f"CASE WHEN sale AND code = 'US-CA' THEN {_q(_A['sale_ca'])} WHEN sale THEN {_q(_A['sale'])} END", f"CASE WHEN rights AND code IN ('GDPR', 'UK-GDPR') THEN {_q(_A['rights_eu'])} END"]
    + [f"CASE WHEN {k} THEN {_q(_A[k])} END" for k in ("rights", "training", "automation", "children")]
)


@query(f"""WITH {_FINDINGS}, g AS (SELECT p.doc_id, any_value(context) AS context, any_value(jurisdiction) AS code, count(category) AS n, {', '.join(map(_flag, advice.ADVICE_FOR))} FROM policies p LEFT JOIN findings f ON p.doc_id = f.doc_id GROUP BY p.doc_id),
l AS (SELECT doc_id, n, list_filter([{_LINES}], lambda x: x IS NOT NULL) AS l FROM g)
SELECT doc_id, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], '|') END AS items FROM l""")
def v7_actions(spark, d):
    p = views.policies(spark, d)
    return advice.action_items(rules.rule_hits(p), p.select("doc_id", "context", F.array("jurisdiction").alias("codes"))).select("doc_id", F.array_join("action_items", "|").alias("items"))


_TOLD = " || ".join([f"CASE WHEN severity IN ('High', 'Critical') THEN [{', '.join(map(_q, advice.SEVERE))}] ELSE [] END"] + [
    f"CASE WHEN {' OR '.join(f'contains(lower(category), {_q(p)})' for p in parts)} THEN [{', '.join(map(_q, lines))}] ELSE [] END" for parts, lines in advice.SUGGESTIONS])


@query(f"WITH {_FINDINGS}, t AS (SELECT doc_id, ord, {_TOLD} AS t FROM findings) SELECT doc_id, ord, array_to_string(CASE WHEN len(t) > 0 THEN t ELSE [{', '.join(map(_q, advice.OTHERWISE))}] END, '|') AS told FROM t")
def v8_suggestions(spark, d):
    return rules.rule_hits(views.policies(spark, d)).select("doc_id", "ord", F.array_join(advice.action_suggestions(F.col("category"), F.col("severity")), "|").alias("told"))


_NAMES = "CASE c " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in advice.CODE_NAMES.items()) + " ELSE c END"


@query(f"WITH {_FINDINGS}, n AS (SELECT doc_id, ord, list_transform(jurisdictions, lambda c: {_NAMES}) AS n FROM findings) SELECT doc_id, ord, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ',') AS names FROM n")
def v10_friendly(spark, d):
    return rules.rule_hits(views.policies(spark, d)).select("doc_id", "ord", F.array_join(advice.friendly_jurisdictions(F.col("jurisdictions")), ",").alias("names"))


@query(f"WITH {views.SQL_MODEL} SELECT doc_id, ord, severity, category, round_even(confidence::DOUBLE * 100, 0)::INT || '%' AS confidence, excerpt FROM model")
def v11_table(spark, d):
    return advice.findings_table(views.model_findings(spark, d))


@query()
def v9_simplify(spark, d):
    """Explanations of findings in plain words for children."""
    f = rules.detect_findings(views.policies(spark, d), carry=("context",))
    return f.select("doc_id", "ord", advice.simplify_explanation(F.col("explanation"), F.col("context")).alias("told"))


@query()
def v12_spans(spark, d):
    """Where the excerpts of model findings stand in the policies."""
    return advice.highlight_spans(views.policies(spark, d), views.model_findings(spark, d))


# --- listings and reports -----------------------------------------------------------------------
@query(f"{_ANALYSES} SELECT doc_id, name, grade, risk_score::DOUBLE AS risk_score FROM analyses ORDER BY created_at DESC, doc_id LIMIT 25")
def w9_latest(spark, d):
    return reports.latest_analyses(views.analyses(spark, d)).select("doc_id", "name", "grade", "risk_score")


@query(f"{_ANALYSES} SELECT doc_id, name, doc_type, url, status, printf('%.2f', confidence::DOUBLE) AS confidence, printf('%.2f', risk_score::DOUBLE) AS risk_score, grade, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM analyses")
def s9_summary_csv(spark, d):
    return reports.summary_csv_rows(views.analyses(spark, d))


@query(f"WITH {_FINDINGS}, {_MERGED}, {_analysed('merged')} SELECT doc_id, {_GRADE} AS grade, risk_score, {_verdict(0)} AS verdict_label, n_findings AS num_findings, n_high AS num_high, n_medium AS num_medium FROM chipped")
def s10_batch_summary(spark, d):
    done, _ = analysis.analyze_batch(_batches(spark, d), model=views.model_findings(spark, d), answers=views.model_answers(spark, d))
    return reports.batch_summary(done.withColumn("url", F.lit(""))).select("doc_id", "grade", "risk_score", "verdict_label", "num_findings", "num_high", "num_medium")


@query(f"""WITH {views.SQL_ANALYSES} SELECT doc_id, json_extract_string(j, '$.name') AS name, json_extract_string(j, '$.grade') AS grade, json_extract_string(j, '$.status') AS status FROM (SELECT doc_id, to_json({{'name': name, 'grade': grade, 'status': status}}) AS j FROM analyses)""")
def s11_json(spark, d):
    """Whole rows as JSON, read back."""
    j = reports.export_json(views.analyses(spark, d))
    return j.select("doc_id", *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("name", "grade", "status")])


@query(f"""{_ANALYSES}, s AS (SELECT avg(risk_score)::DOUBLE AS risk, avg(confidence)::DOUBLE AS sure, avg((status = 'needs_review')::INT) AS rate FROM analyses),
p AS (SELECT 10 - risk AS base, sure * 10 AS conf, 10 - rate * 10 AS rev, 8.5 * sure + 1.5 * (1 - rate) AS ai FROM s)
SELECT round(base, 6) AS product_integrity, round(ai, 6) AS ai_law_signal_quality, round(rev * 0.6 + conf * 0.4, 6) AS accessibility_usability,
  round(0.20 * base + 0.20 * conf + 0.10 * ai + 0.10 * (base * 0.9 + conf * 0.1) + 0.15 * (rev * 0.6 + conf * 0.4) + 0.10 * (rev * 0.5 + base * 0.5) + 0.10 * (rev * 0.7 + base * 0.3) + 0.05 * rev, 6) AS overall FROM p""")
def a4_rubric(spark, d):
    return reports.rubric_scores(views.analyses(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("product_integrity", "ai_law_signal_quality", "accessibility_usability", "overall")])


@query(f"WITH {_FINDINGS} SELECT doc_id, severity, ord, count(*) OVER (PARTITION BY doc_id, severity) AS n, round_even(confidence::DOUBLE * 100, 0)::INT || '%' AS confidence, array_to_string(legal_basis, ', ') AS legal_basis FROM findings")
def a6_report(spark, d):
    return reports.report_sections(rules.detect_findings(views.policies(spark, d))).select("doc_id", "severity", "ord", "n", "confidence", "legal_basis")


_VENDORS = [f"src{k}" for k in range(20)]


@query(f"""WITH {views.SQL_MODEL}, {views.SQL_ANALYSES}, m AS (SELECT 'risk' AS metric, vendor, round(avg(risk_score), 6)::DOUBLE AS value FROM analyses GROUP BY vendor),
c AS (SELECT 'findings: ' || category AS metric, vendor, count(*)::DOUBLE AS value FROM model JOIN analyses USING (doc_id) GROUP BY category, vendor), e AS (SELECT * FROM m UNION ALL SELECT * FROM c),
w AS (SELECT x.metric, v.vendor, coalesce(e.value, 0) AS value FROM (SELECT DISTINCT metric FROM e) x CROSS JOIN (SELECT unnest([{', '.join(map(_q, _VENDORS))}]) AS vendor) v LEFT JOIN e ON e.metric = x.metric AND e.vendor = v.vendor)
SELECT metric, {', '.join(f"max(value) FILTER (vendor = '{v}') AS {v}" for v in _VENDORS)}, arg_min(vendor, (value, vendor)) AS best FROM w GROUP BY metric""")
def a17_compare(spark, d):
    return rollups.vendor_compare(views.analyses(spark, d), views.model_findings(spark, d), _VENDORS)


@query(f"""WITH b AS (SELECT doc_id // 20 AS batch, doc_id % 20 AS idx, trim({views.sql_pick(['GDPR', '', 'US-CA', ' ', ' GDPR '], 'doc_id // 3')}) AS code FROM documents), f AS (SELECT batch, code, min(idx) AS idx FROM b WHERE code <> '' GROUP BY 1, 2)
SELECT batch, coalesce((SELECT string_agg(code, ',' ORDER BY idx) FROM f WHERE f.batch = a.batch), '') AS codes FROM (SELECT DISTINCT batch FROM b) a""")
def a18_batch_codes(spark, d):
    i = F.col("doc_id")
    rows = views.table(spark, d, "documents").select(F.floor(i / 20).alias("batch"), (i % 20).alias("idx"), views.pick(["GDPR", "", "US-CA", " ", " GDPR "], F.floor(i / 3)).alias("jurisdiction"))
    return reports.batch_jurisdictions(rows).select("batch", F.array_join("codes", ",").alias("codes"))


@query(f"WITH {_FINDINGS}, {_SCORES} SELECT round(CASE WHEN chance = 1 THEN 1 ELSE (seen - chance) / (1 - chance) END, 6)::DOUBLE AS kappa FROM pool")
def a15_kappa_pooled(spark, d):
    """The scan held against the planted clauses, all pairs of document and category pooled."""
    docs = views.table(spark, d, "documents").select("doc_id")
    c = rollups.confusion(_gold(docs), rules.rule_hits(views.policies(spark, d)), docs, sorted({r.category for r in catalog.RULES}))
    return rollups.kappa_pooled(c).select(F.round("kappa", 6).alias("kappa"))


@query(f"""WITH {_FINDINGS}, {_SCORES}, each_ AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN chance >= 1 THEN 0 ELSE ((tp + tn) / n - chance) / (1 - chance) END AS kappa FROM k)
SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1, round(avg(kappa), 6) AS macro_kappa,
  (SELECT round(CASE WHEN chance = 1 THEN 1 ELSE (seen - chance) / (1 - chance) END, 6)::DOUBLE FROM pool) AS pooled_kappa FROM each_""")
def e3_evaluate(spark, d):
    """The scan held against the planted clauses, one row of means."""
    docs = views.table(spark, d, "documents").select("doc_id")
    e = rollups.evaluate(_gold(docs), rules.rule_hits(views.policies(spark, d)), docs, sorted({r.category for r in catalog.RULES}))
    return e.select(*[F.round(c, 6).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "macro_kappa", "pooled_kappa")])


_THREE = "CASE WHEN {0} % 10 < 5 THEN 'R' WHEN {0} % 10 < 8 THEN 'Y' ELSE 'G' END"


@query(f"""WITH p AS (SELECT (doc_id % 4)::VARCHAR AS category, {_THREE.format('doc_id')} AS gold, CASE WHEN doc_id % 11 < 7 THEN {_THREE.format('doc_id')} ELSE {_THREE.format('(doc_id // 3)')} END AS said FROM documents),
l AS (SELECT category, x, count(*) FILTER (gold = x AND said = x) AS tp, count(*) FILTER (gold = x) AS g, count(*) FILTER (said = x) AS s, count(*) AS n FROM p, (VALUES ('R'), ('Y'), ('G')) AS v(x) GROUP BY 1, 2)
SELECT category, any_value(n) AS n, round(avg(CASE WHEN g + s > 0 THEN 2.0 * tp / (g + s) ELSE 0 END), 6)::DOUBLE AS macro_f1, round((sum(tp) / any_value(n)::DOUBLE - sum(g * s) / (any_value(n)::DOUBLE * any_value(n))) / (1 - sum(g * s) / (any_value(n)::DOUBLE * any_value(n))), 6)::DOUBLE AS kappa FROM l GROUP BY category""")
def a16_multiclass(spark, d):
    i = F.col("doc_id")
    three = lambda x: F.when(x % 10 < 5, "R").when(x % 10 < 8, "Y").otherwise("G")
    pairs = views.table(spark, d, "documents").select((i % 4).cast("string").alias("category"), three(i).alias("gold"), F.when(i % 11 < 7, three(i)).otherwise(three(F.floor(i / 3))).alias("predicted"))
    return rollups.multiclass(pairs).select("category", "n", F.round("macro_f1", 6).alias("macro_f1"), F.round("kappa", 6).alias("kappa"))


# --- signals and portfolios ---------------------------------------------------------------------
def _m(pattern: str) -> str:
    return f"regexp_matches(text, {_q('(?i)' + pattern)})"


def _issue(name: str) -> str:
    likely, impact, guard, good, bad = signals.ISSUES[name]
    said = f"WHEN {_m(signals.SIGNALS[name])}{' OR minors' if name == 'Minors' else ''} THEN {likely}" + (f" WHEN {_m(signals.SIGNALS['OptOut'])} THEN 3" if name == "SaleShare" else "")
    weight = f"CASE WHEN {_m(signals.OPEN_END)} THEN 3 ELSE {impact} END" if name == "Retention" else str(impact)
    return f"SELECT doc_id, {_q(name)} AS category, {weight} AS i, CASE {said} ELSE 0 END AS l, CASE WHEN {_m(guard)} THEN {good} ELSE {bad} END AS s FROM flagged"


_ISSUES = f"""{views.SQL_POLICIES}, {views.SQL_ROLLUPS}, flagged AS (SELECT doc_id, text, industry, jurisdiction, doc_id % 3 = 0 AS minors, doc_id % 4 > 0 AS optin FROM policies),
issues AS (SELECT *, greatest(0, least(1, round(0.5 * (i / 5.0) + 0.4 * (l / 5.0) - 0.3 * (s / 5.0), 4)))::DOUBLE AS irp FROM ({' UNION ALL '.join(map(_issue, signals.ISSUES))}))"""
_HAVE = " + ".join(f"{_m(p)}::INT" for p in signals.EXPECTED)
_CRS = f"""crs AS (SELECT doc_id, greatest(max(irp), 0.5 * avg(irp)) AS crs FROM issues GROUP BY doc_id), have AS (SELECT doc_id, ({_HAVE}) / 6.0 AS share FROM flagged)"""


def _flagged(spark, d):
    i = F.col("doc_id")
    return views.policies(spark, d).withColumns({"minors": i % 3 == 0, "optin": i % 4 > 0})


@query(f"WITH {_ISSUES} SELECT doc_id, category, irp, CASE WHEN irp >= 0.75 THEN 'red' WHEN irp >= 0.45 THEN 'yellow' ELSE 'green' END AS colour FROM issues")
def m10_signals(spark, d):
    return signals.issue_scores(_flagged(spark, d)).select("doc_id", "category", "irp", "colour")


@query(f"WITH {_ISSUES} SELECT doc_id, category, k::INT AS k FROM (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id ORDER BY irp DESC, category) AS k FROM issues) WHERE k <= 3")
def w4_top_risks(spark, d):
    return scoring.top_risks(signals.issue_scores(_flagged(spark, d))).select("doc_id", "category", "k")


_OBS = ", ".join(f"CASE WHEN {'' if present else 'NOT '}{_m(p)}{' AND minors' if name == 'no word on minors' else ''} THEN {_q(name)} END" for name, (p, present) in signals.OBSERVED.items())


@query(f"WITH {_ISSUES} SELECT doc_id, unnest(list_filter([{_OBS}], lambda x: x IS NOT NULL)) AS observation FROM flagged")
def m11_observations(spark, d):
    return signals.observations(_flagged(spark, d)).select("doc_id", "observation")


@query(f"""WITH {_ISSUES}, {_CRS}, c AS (SELECT doc_id, crs, share, CASE WHEN crs >= 0.70 THEN 'red' WHEN crs >= 0.40 THEN 'yellow' ELSE 'green' END AS colour FROM crs JOIN have USING (doc_id))
SELECT doc_id, round(crs, 6) AS crs, colour, CASE WHEN colour = 'red' OR share < 0.4 THEN 'Stop' WHEN colour = 'green' AND share >= 0.7 THEN 'Go' ELSE 'Review' END AS action, round(share * 100, 0)::INT AS percent FROM c""")
def m13_composite(spark, d):
    f = _flagged(spark, d)
    pct = signals.expected_sections_pct(f)
    return signals.composite_risk(signals.issue_scores(f), pct).join(pct, "doc_id").select("doc_id", F.round("crs", 6).alias("crs"), "colour", "action", "percent")


_FLAT = r"regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g')"


def _around(word: str) -> str:
    at, n = f"strpos(lower(text), {_q(word)})", len(word)
    first, last = f"greatest({at} - 61, 0)", f"least(length(text), {at} - 1 + {n} + 120)"
    return f"CASE WHEN {at} = 0 THEN '' ELSE substr(text, {first} + 1, {last} - {first}) || CASE WHEN {last} < length(text) THEN '…' ELSE '' END END"


def _heuristic(h) -> str:
    category, severity, score, words, shown, rights = h
    hit = _m(words) if words else f"NOT {_m(signals.RIGHTS_WORDS)}"
    excerpt = "coalesce(" + ", ".join([f"nullif({_around(w)}, '')" for w in shown] + ["''"]) + ")"
    return f"SELECT doc_id, {_q(category)} AS category, {score}::DOUBLE AS score, {excerpt} AS excerpt, {len(rights)} AS n FROM flat WHERE {hit}"


@query(f"WITH {views.SQL_POLICIES}, flat AS (SELECT doc_id, {_FLAT} AS text FROM policies) {' UNION ALL '.join(map(_heuristic, signals.HEURISTICS))}")
def m15_absence(spark, d):
    return signals.absence_findings(views.policies(spark, d)).select("doc_id", "category", "score", "excerpt", F.size("rights").alias("n"))


@query(f"""WITH {_ISSUES}, {_CRS} SELECT industry, jurisdiction, round(coalesce(avg(crs) FILTER (optin), 0), 6)::DOUBLE AS mean, count(*) FILTER (optin) AS n FROM flagged JOIN crs USING (doc_id)
GROUP BY 1, 2 HAVING count(*) FILTER (optin) > 0 UNION ALL SELECT i.industry, j.jurisdiction, 0, 0 FROM (SELECT DISTINCT industry FROM flagged WHERE optin) i, (SELECT DISTINCT jurisdiction FROM flagged WHERE optin) j WHERE (i.industry, j.jurisdiction) NOT IN (SELECT (industry, jurisdiction) FROM flagged WHERE optin)""")
def e4_portfolio(spark, d):
    _, heat, _ = signals.portfolio(_flagged(spark, d))
    return heat.select("industry", "jurisdiction", F.round("mean", 6).alias("mean"), "n")


# --- text, versions, watch ----------------------------------------------------------------------
@query(f"WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r]') AS s FROM documents)) SELECT doc_id, k::INT AS line, unnest(range(len(t)))::INT AS n, unnest(t) AS token FROM (SELECT doc_id, k, {_TOKENS.format('line')} AS t FROM l)")
def x5_tokens(spark, d):
    return versions.tokenize_with_lines(views.table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 5) AS total FROM embeddings")
def x9_normalize(spark, d):
    unit = views.table(spark, d, "embeddings").select("vec_id", retrieval.l2_normalize(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query()
def x10_prompts(spark, d):
    """Prompts of the documents' findings and of the passages that fit a question on the like number; one passage in five is a placeholder."""
    f = views.model_findings(spark, d)
    i = F.col("chunk_id")
    p = retrieval.quality_flags(retrieval.retrieve(_asked(spark, d), _chunks(spark, d), 3).select("query_id", "chunk_id", "rank").withColumn("status", F.when(i % 5 == 0, "Placeholder").otherwise("final")))
    p = p.join(views.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("law"), F.substring("text", 1, 500).alias("text")), "chunk_id").select(F.col("query_id").alias("doc_id"), "rank", "law", F.lit("1").alias("section"), "text", "placeholder")
    return reports.prompt_rows(views.policies(spark, d), f, p)


@query(f"WITH {views.SQL_VERSIONS} SELECT url, version, captured_at, (4 - version)::INT AS place FROM versions")
def w10_history(spark, d):
    return versions.snapshot_history(views.versions(spark, d)).select("url", "version", "captured_at", "place")


@query()
def d1_line_diff(spark, d):
    return versions.line_diff(versions.version_pairs(views.versions(spark, d)))


@query()
def d4_severity_summary(spark, d):
    return versions.diff_severity_summary(versions.token_diff(versions.version_pairs(views.versions(spark, d))))


@query()
def r3_relevant_chunks(spark, d):
    """Each policy cut down to what fits a question, by its own chunks' words and vectors."""
    p = views.policies(spark, d).select("doc_id", "text")
    v = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("world"))
    n = v.count()
    chunks = text.chunk_text(p).select("doc_id", "n", F.pmod(F.col("doc_id") * 31 + F.col("n"), F.lit(n)).alias("vec_id")).join(v, "vec_id").select("doc_id", "n", "world", F.lit(None).cast("array<double>").alias("eu"))
    world = [float(x) for x in v.orderBy("vec_id").first()["world"]]
    return retrieval.select_relevant_chunks(p, "personal data rights retention", chunks, {"world": world}, 2000)


_RISKY = "(doc_id * 7 + version * 31) % 90 / 10.0"


@query(f"""WITH v AS (SELECT doc_id, v AS version FROM documents, range(0, 4) AS t(v)), f AS (SELECT doc_id, version, c AS category FROM v, range(0, 5) AS t(c) WHERE (doc_id * 3 + version * 5 + c * 7) % 11 < 2),
n AS (SELECT a.doc_id, a.version, count(*) AS n FROM f a WHERE a.version > 0 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = a.doc_id AND b.version = a.version - 1 AND b.category = a.category) GROUP BY 1, 2),
r AS (SELECT doc_id, version, round({_RISKY} - {_RISKY.replace('version', '(version - 1)')}, 2)::DOUBLE AS delta FROM v WHERE version > 0)
SELECT doc_id, r.version::INT AS version, delta, coalesce(n, 0) AS n_new_high FROM r LEFT JOIN n ON n.doc_id = r.doc_id AND n.version = r.version WHERE abs(delta) >= 1 OR n > 0""".replace("SELECT doc_id, r.version", "SELECT r.doc_id, r.version"))
def d7_significant(spark, d):
    i, v = F.col("doc_id"), F.col("version")
    risk = lambda x: (i * 7 + x * 31) % 90 / 10.0
    each = views.table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("version"))
    pairs = each.filter("version > 0").select(i.cast("string").alias("url"), "version", (v - 1).alias("old_version"), risk(v).alias("risk"), risk(v - 1).alias("old_risk"))
    f = each.select("doc_id", "version", F.explode(F.array(*map(F.lit, range(5)))).alias("category")).filter((i * 3 + v * 5 + F.col("category") * 7) % 11 < 2).select(i.cast("string").alias("url"), "version", "category", F.lit("High").alias("severity"))
    return versions.significant_changes(pairs, f).select(F.col("url").cast("long").alias("doc_id"), "version", F.col("delta").cast("double").alias("delta"), F.col("n_new_high").cast("long").alias("n_new_high"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 6 <> 0 AND doc_id % 5 <> 0 THEN strftime(TIMESTAMP '2024-02-01 00:00:00' + to_seconds(doc_id % 7 * 3600 + 3600), '%Y-%m-%d %H:%M:%S') END AS next_check FROM documents")
def w12_listing(spark, d):
    return versions.watchlist_listing(views.watched(spark, d)).select("id", F.date_format("next_check_at", "yyyy-MM-dd HH:mm:ss").alias("next_check"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0")
def j11_remove(spark, d):
    ids = views.table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    return reports.remove_items(views.watched(spark, d), ids).select("id")


_ENABLED = ["true", " YES ", "off", "maybe"]


@query(f"""WITH l AS (SELECT doc_id, 'https://site' || (doc_id * 2) || '.com/privacy' AS url, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id END AS user_id, doc_id % 3 * 600 AS every, {views.sql_pick(_ENABLED, 'doc_id')} AS enabled FROM documents),
w AS (SELECT doc_id AS id, 'https://site' || doc_id || '.com/privacy' AS source_url, doc_id % 4 <> 0 AS enabled, CASE WHEN doc_id % 6 <> 0 THEN 3600 ELSE 86400 END AS every, CASE WHEN doc_id % 8 = 0 THEN 'own' END AS user_id FROM documents)
SELECT coalesce(w.source_url, l.url) AS source_url, w.id IS NULL AS inserted, CASE WHEN w.id IS NULL THEN regexp_extract(l.url, '//([^/]+)', 1) ELSE 'own' END AS vendor, coalesce(w.user_id, l.user_id) AS user_id,
  CASE WHEN w.id IS NULL OR (l.url IS NOT NULL AND w.every = 86400) THEN CASE WHEN l.every = 0 THEN 86400 ELSE l.every END ELSE w.every END::INT AS check_frequency,
  CASE WHEN w.id IS NULL THEN l.enabled IN ('true', ' YES ') ELSE w.enabled AND coalesce(l.enabled IN ('true', ' YES '), true) END AS enabled FROM w FULL JOIN l ON w.source_url = l.url""")
def j7_legacy_watch(spark, d):
    i = F.col("doc_id")
    docs = views.table(spark, d, "documents")
    legacy = docs.select(i.alias("id"), views.page_url(i * 2).alias("url"), F.when(i % 2 == 0, F.concat(F.lit("u"), i.cast("string"))).alias("user_id"), (i % 3 * 600).cast("int").alias("check_frequency"), views.pick(_ENABLED, i).alias("enabled"), F.lit(None).cast("timestamp").alias("created_at"))
    watch = docs.select(
        i.alias("id"), F.lit("own").alias("vendor"), views.page_url(i).alias("source_url"), F.lit("No Changes").alias("status"), F.when(i % 8 == 0, "own").alias("user_id"), F.when(i % 6 != 0, 3600).otherwise(86400).alias("check_frequency"), (i % 4 != 0).alias("enabled"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    merged, _ = versions.merge_legacy_watch(legacy, watch, F.lit("2024-01-01").cast("timestamp"))
    return merged.select("source_url", F.col("id").isNull().alias("inserted"), "vendor", "user_id", F.col("check_frequency").cast("int").alias("check_frequency"), "enabled")


@query("SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'Unknown vendor' ELSE lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) END AS vendor FROM pages")
def j9_vendor(spark, d):
    return views.table(spark, d, "pages").select("page_id", versions.vendor_from_url(F.when(F.col("page_id") % 9 == 0, "no url").otherwise(F.col("url"))).alias("vendor"))


@query("""WITH n AS (SELECT count(*) AS n, min(len(embedding)) AS a, max(len(embedding)) AS z FROM embeddings), lost AS (SELECT count(*) AS lost FROM embeddings e ANTI JOIN embeddings o ON e.vec_id = o.vec_id + 1),
c AS (SELECT * FROM (VALUES ('whole', '1', 0, 0, false), ('old vectors', '0', 0, 0, false), ('one too many', '1', 1, 0, false), ('wide', '1', 0, 1, false), ('shifted', '1', 0, 0, true)) AS t(bundle, version, more, wider, shifted))
SELECT bundle, reason IS NULL AS ok, reason FROM (SELECT bundle, CASE WHEN version <> '1' THEN 'versions differ' WHEN n + more <> n THEN 'counts differ' WHEN a <> 64 + wider OR z <> 64 + wider THEN 'vector sizes differ' WHEN shifted AND lost > 0 THEN 'chunks without vectors' END AS reason FROM c, n, lost)""")
def j14_bundle_guard(spark, d):
    """Bundles of the given vectors: one whole, and one for each way in which a bundle can be wrong."""
    v = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("vector"))
    n, out = v.count(), None
    for bundle, version, more, wider, shift in (("whole", "1", 0, 0, 0), ("old vectors", "0", 0, 0, 0), ("one too many", "1", 1, 0, 0), ("wide", "1", 0, 1, 0), ("shifted", "1", 0, 0, 1)):
        manifest = spark.createDataFrame([("1", "1", version, n + more, 64 + wider)], "version string, chunks_version string, vectors_version string, n_chunks long, size int")
        one = retrieval.bundle_guard(v.select("chunk_id"), v.withColumn("chunk_id", F.col("chunk_id") + shift), manifest).select(F.lit(bundle).alias("bundle"), "ok", "reason")
        out = one if out is None else out.unionByName(one)
    return out


# --- event time ---------------------------------------------------------------------------------
@query(f"""WITH {views.SQL_ROLLUPS}, w AS (SELECT crs, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS start, ts FROM rollups, range(0, 4) AS t(k))
SELECT start, count(*) AS n, sum(crs::DECIMAL(18, 10))::DOUBLE / count(crs) AS mean FROM w WHERE ts < start + INTERVAL '24 hours' GROUP BY start""")
def d11_sliding(spark, d):
    return streams.stream_kpis(views.rollups(spark, d), "24 hours", slide="6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean")


@query(f"""WITH {views.SQL_ROLLUPS}, s AS (SELECT industry, ts, crs, CASE WHEN ts < lag(ts) OVER (PARTITION BY industry ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM rollups),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY industry ORDER BY ts) AS k FROM s) SELECT industry, min(ts) AS start, count(*) AS n, sum(crs::DECIMAL(18, 10))::DOUBLE / count(crs) AS mean FROM g GROUP BY industry, k""")
def d11_sessions(spark, d):
    return streams.stream_sessions(views.rollups(spark, d)).select("industry", F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean")
