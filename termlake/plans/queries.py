"""The registered queries of the policy operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog, text
from ..functions.catalog import CLAUSES, CONTEXT_PRIORITY, RULES
from ..operators import analysis, inference, retrieval, rollups, rules, scoring, search_index, versions
from ..sources import readers
from ..sources.store import scratch
from ..streaming import streams
from . import policies as views
from .policies import _q

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _case(table: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {default} END" if table else default


def _edges(pattern: str) -> str:
    """DuckDB's word boundary knows ASCII only; spell it out."""
    return r"(^|[^\pL\pN_])" + pattern.removeprefix(r"\b").removesuffix(r"\b") + r"($|[^\pL\pN_])"


_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({k}, {_q(r.category)}, {_q(r.severity)}, {len(r.patterns)}, {catalog.IRP.get(r.category, catalog.IRP_DEFAULT)[0]}, {catalog.IRP.get(r.category, catalog.IRP_DEFAULT)[1]}, "
    f"[{', '.join(map(_q, r.jurisdictions))}], [{', '.join(map(_q, r.legal_basis))}]::VARCHAR[])" for k, r in enumerate(RULES)
) + ") AS t(ord, category, severity, n_patterns, impact, likelihood, jurisdictions, legal_basis))"
_PATTERNS = "patterns AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {j}, {_q('(?i)' + p)})" for k, r in enumerate(RULES) for j, p in enumerate(r.patterns)) + ") AS t(ord, j, p))"


def _per_pattern(text_: str = "text") -> str:
    """Matches of each pattern; one SELECT per pattern, as DuckDB compiles constant patterns once."""
    return "hits AS (" + " UNION ALL ".join(
        f"SELECT doc_id, {k} AS ord, {j} AS j, len(regexp_extract_all({text_}, {_q('(?i)' + p)})) AS n, length(string_split_regex({text_}, {_q('(?i)' + p)})[1]) AS start, length(regexp_extract({text_}, {_q('(?i)' + p)})) AS size FROM policies WHERE regexp_matches({text_}, {_q('(?i)' + p)})"
        for k, r in enumerate(RULES) for j, p in enumerate(r.patterns)
    ) + ")"


_FINDINGS = f"""{views.SQL_POLICIES}, {_RULES}, {_per_pattern()},
best AS (SELECT doc_id, ord, count(*) AS hits, sum(n) AS matches, arg_min(start, j) AS start, arg_min(size, j) AS size FROM hits GROUP BY 1, 2),
findings AS (
  SELECT b.doc_id, b.ord, r.category, r.severity, r.jurisdictions, r.legal_basis, hits, matches, start, start + size AS stop, r.impact, r.likelihood,
    CASE WHEN hits >= n_patterns * 0.5 THEN 0.93 + 0.02 * least(1.0, hits::DOUBLE / n_patterns) ELSE 0.90 + 0.03 * (hits::DOUBLE / n_patterns) END AS confidence,
    round(0.5 * (impact / 5.0) + 0.4 * (likelihood / 5.0), 4)::DOUBLE AS irp_score
  FROM best b JOIN rules r USING (ord))"""
_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH {_FINDINGS}
SELECT doc_id, ord, category, severity, round(confidence, 6) AS confidence, start AS start_offset, stop AS end_offset, irp_score,
  {_TRIM("substr(text, greatest(0, start - 140) + 1, stop + 140 - greatest(0, start - 140))")} AS excerpt,
  length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1 AS line_start
FROM findings JOIN policies USING (doc_id)""")
def m2_findings(spark, d):
    return rules.detect_findings(views.policies(spark, d)).select("doc_id", "ord", "category", "severity", F.round("confidence", 6).alias("confidence"), "start_offset", "end_offset", "irp_score", "excerpt", F.col("line_start").cast("long").alias("line_start"))


@query(f"WITH {_FINDINGS} SELECT doc_id, ord, hits, matches, start AS start_offset, stop AS end_offset FROM findings")
def m1_match_stats(spark, d):
    return rules.match_stats(views.policies(spark, d)).select("doc_id", "ord", "hits", "matches", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"))


@query(f"WITH {_FINDINGS} SELECT doc_id, ord, category FROM findings WHERE list_has_any(jurisdictions, ['GDPR'])")
def p3_jurisdiction_filter(spark, d):
    return rules.rule_hits(views.policies(spark, d), codes=["GDPR"]).select("doc_id", "ord", "category")


_SIZES = "list_transform({}, lambda x: length(x))"


@query("WITH " + views.SQL_POLICIES + f", {_RULES}, q AS (" + " UNION ALL ".join(
    f"SELECT doc_id, text, {k} AS ord, {j} AS pattern, string_split_regex(text, {_q('(?im)' + p)}) AS pieces, regexp_extract_all(text, {_q('(?im)' + p)}) AS hits FROM policies"
    for k, r in enumerate(RULES) if r.severity in ("High", "Critical") for j, p in enumerate(r.patterns)) + f"""),
h AS (SELECT doc_id, text, ord, pattern, i - 1 AS n, coalesce(list_sum({_SIZES.format('pieces[1:i]')}), 0) + coalesce(list_sum({_SIZES.format('hits[1:i - 1]')}), 0) AS start, length(hits[i]) AS size FROM q, unnest(range(1, len(hits) + 1)) AS t(i))
SELECT doc_id, ord, pattern, n, category, severity, array_to_string(legal_basis, ',') AS legal_basis, round(0.5 * (impact / 5.0) + 0.4 * (likelihood / 5.0), 4)::DOUBLE AS irp_score,
  {_TRIM("substr(text, (greatest(0, start - 50) + 1)::BIGINT, (start + size + 50 - greatest(0, start - 50))::BIGINT)")} AS excerpt,
  length(substr(text, 1, start::BIGINT)) - length(replace(substr(text, 1, start::BIGINT), chr(10), '')) + 1 AS line_start FROM h JOIN rules USING (ord)""")
def m7_quick(spark, d):
    return rules.detect_quick(views.policies(spark, d)).select("doc_id", "ord", "pattern", F.col("n").cast("long").alias("n"), "category", "severity", F.array_join("legal_basis", ",").alias("legal_basis"), "irp_score", "excerpt", F.col("line_start").cast("long").alias("line_start"))


_COMPLETE = " + ".join(f"regexp_matches(text, {_q('(?i)' + p)})::INT" for p in catalog.SECTIONS.values())


@query(f"WITH {views.SQL_POLICIES} SELECT doc_id, round_even(({_COMPLETE}) / 8.0, 2)::DOUBLE AS completeness FROM policies")
def m9_completeness(spark, d):
    return views.policies(spark, d).select("doc_id", rules.completeness(F.col("text")).alias("completeness"))


_GRADE = "CASE " + " ".join(f"WHEN risk_score >= {b} THEN {_q(g)}" for b, g in catalog.GRADES) + " ELSE 'A' END"
_RISK = f"risk AS (SELECT doc_id, coalesce(round_even(sum(irp_score::DECIMAL(10, 6))::DOUBLE / count(irp_score) * 10, 2), 0.0)::DOUBLE AS risk_score FROM policies LEFT JOIN findings USING (doc_id) GROUP BY doc_id)"


@query(f"WITH {_FINDINGS}, {_RISK} SELECT doc_id, risk_score, {_GRADE} AS grade FROM risk")
def a1_risk_grade(spark, d):
    p = views.policies(spark, d)
    return scoring.risk_scores(rules.rule_hits(p), p)


@query(f"""WITH {_FINDINGS}, c AS (SELECT doc_id, list(DISTINCT c ORDER BY c) AS codes FROM findings, unnest(jurisdictions) AS t(c) GROUP BY doc_id)
SELECT doc_id, count(*) FILTER (severity = 'Critical') AS n_critical, count(*) FILTER (severity = 'High') AS n_high, count(*) FILTER (severity = 'Medium') AS n_medium,
  count(*) FILTER (severity = 'Low') AS n_low, any_value(array_to_string(c.codes, ',')) AS codes FROM findings JOIN c USING (doc_id) GROUP BY doc_id""")
def a5_severity(spark, d):
    return rollups.severity_counts(rules.rule_hits(views.policies(spark, d))).withColumn("codes", F.array_join("codes", ","))


_EXCERPT = _TRIM("substr(text, greatest(0, start - 140) + 1, stop + 140 - greatest(0, start - 140))")
_SQUASH = lambda x: f"lower(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^ | $', '', 'g'))"
_LINE = lambda at: f"length(substr(text, 1, {at})) - length(replace(substr(text, 1, {at}), chr(10), '')) + 1"
_N_LINES = r"len(string_split_regex(regexp_replace(text, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'))"


def _validation(source: str) -> str:
    """Confidence left over of the findings of `source`(doc_id, excerpt, line_start, line_end, jurisdictions, legal_basis, confidence)."""
    return f"""checked AS (
  SELECT s.doc_id, confidence, (excerpt = '')::INT AS no_excerpt, (line_start < 1 OR line_end < 1 OR line_start > line_end)::INT AS bad_lines, (line_start > {_N_LINES} OR line_end > {_N_LINES})::INT AS beyond,
    (len(jurisdictions) = 0)::INT AS no_place, (len(legal_basis) = 0)::INT AS uncited, (excerpt <> '' AND contains({_SQUASH('text')}, {_SQUASH('excerpt')}))::INT AS covered FROM {source} s JOIN policies USING (doc_id)),
flagged AS (SELECT doc_id, confidence, covered, uncited, no_excerpt + bad_lines + beyond + (no_excerpt = 0 AND covered = 0)::INT AS flags, no_place FROM checked),
summed AS (SELECT doc_id, avg(confidence) AS mean, sum(flags + no_place + uncited) AS n, sum(uncited) AS uncited, sum(flags) AS flags, avg(covered) AS coverage FROM flagged GROUP BY doc_id),
validated AS (SELECT doc_id, coalesce(n + (coverage < 0.7)::INT, 1)::BIGINT AS n_issues,
  CASE WHEN n IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, mean - 0.03 * n - 0.07 * uncited - 0.08 * flags - CASE WHEN coverage < 0.7 THEN 0.2 * (0.7 - coverage) ELSE 0 END)) END AS validation FROM policies LEFT JOIN summed USING (doc_id))"""


_EVIDENCE = f"evidence AS (SELECT f.*, {_EXCERPT} AS excerpt, {_LINE('start')} AS line_start, {_LINE('stop')} AS line_end FROM findings f JOIN policies USING (doc_id))"


@query(f"WITH {_FINDINGS}, {_EVIDENCE}, {_validation('evidence')} SELECT doc_id, n_issues, round(validation, 6) AS validation FROM validated")
def a2_validation(spark, d):
    p = views.policies(spark, d)
    return scoring.validation(rules.detect_findings(p), p).select("doc_id", "n_issues", F.round("validation", 6).alias("validation"))


_WEIGHT = "least(3.0, " + " + ".join(f"CASE context[{i}] " + " ".join(f"WHEN {_q(c)} THEN {_case(t, 'category', '0.0')}" for c, t in catalog.WEIGHTS.items() if t) + " ELSE 0.0 END" for i in (1, 2)) + ")"
_ORDER = f"""ordered AS (SELECT doc_id, ord, category, severity, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, irp_score DESC, sev DESC, ord) AS place
  FROM (SELECT f.doc_id, ord, category, severity, irp_score, {_case({s: k for k, s in enumerate(catalog.SEVERITIES, 1)}, 'severity', '0')} AS sev, CASE WHEN {_WEIGHT} > 0 THEN {_WEIGHT} ELSE 1.0 END AS w FROM findings f JOIN policies USING (doc_id)))"""


def _ordered(spark, d):
    return scoring.surfacing_order(rules.rule_hits(views.policies(spark, d), carry=("context",)))


@query(f"WITH {_FINDINGS}, {_ORDER} SELECT doc_id, ord, place FROM ordered")
def w1_order(spark, d):
    return _ordered(spark, d).select("doc_id", "ord", "place")


@query(f"""WITH {_FINDINGS}, {_ORDER}, k AS (SELECT doc_id, {_case(catalog.DOMAINS, 'category', 'NULL')} AS domain, category, place FROM ordered)
SELECT doc_id, domain, category, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, domain ORDER BY place) AS k FROM k WHERE domain IS NOT NULL) WHERE k <= 2""")
def w3_top_domain(spark, d):
    return scoring.top_by_domain(_ordered(spark, d)).select("doc_id", "domain", "category", "k")


def _boosted(boosts: dict, group: str) -> str:
    return "(" + " OR ".join(f"({group} = {_q(g)} AND category IN ({', '.join(_q(c) for c, b in t.items() if b >= 0.2)}))" for g, t in boosts.items()) + ")::INT"


@query(f"""WITH {_FINDINGS}, f AS (SELECT f.doc_id, ord, category, doc_type, industry, {_case({s: k for k, s in enumerate(catalog.SEVERITIES, 1)}, 'severity', '0')} AS s FROM findings f JOIN policies USING (doc_id))
SELECT doc_id, ord, ['Low', 'Medium', 'High', 'Critical'][least(4, least(4, s + {_boosted(catalog.DOC_TYPE_BOOSTS, 'doc_type')}) + {_boosted(catalog.INDUSTRY_BOOSTS, 'industry')})] AS severity FROM f""")
def v4_severity(spark, d):
    f = rules.rule_hits(views.policies(spark, d), carry=("doc_type", "industry"))
    return f.select("doc_id", "ord", scoring.weighted_severity(F.col("doc_type"), F.col("industry")).alias("severity"))


def _verdict(k: int) -> str:
    return f"CASE {' '.join(f'WHEN chip = {_q(c)} AND readiness = {_q(r)} THEN {_q(v[k])}' for c, t in catalog.VERDICTS.items() for r, v in t.items())} END"


_CHIP = f"CASE {' '.join(f'WHEN list_contains(context, {_q(c)}) THEN {_q(c)}' for c in CONTEXT_PRIORITY)} ELSE 'want_understand' END AS chip"
_READY = "CASE WHEN risk_score >= 7 OR completeness < 0.375 THEN 'Stop' WHEN risk_score < 4 AND confidence >= 0.65 AND completeness >= 0.625 THEN 'Go' ELSE 'Review' END AS readiness"
_SECTIONED = f"sectioned AS (SELECT doc_id, context, doc_type, industry, round_even(({_COMPLETE}) / 8.0, 2)::DOUBLE AS completeness FROM policies)"


@query(f"""WITH {_FINDINGS}, {_EVIDENCE}, {_validation('evidence')}, {_RISK}, {_SECTIONED},
r AS (SELECT doc_id, context, {_READY} FROM (SELECT doc_id, context, risk_score, completeness, 0.8 * validation AS confidence FROM risk JOIN sectioned USING (doc_id) JOIN validated USING (doc_id))), k AS (SELECT doc_id, readiness, {_CHIP} FROM r)
SELECT doc_id, readiness, {_verdict(0)} AS label, {_verdict(1)} AS headline FROM k""")
def v6_verdict(spark, d):
    """With the confidence of a full analysis without a model."""
    p = views.policies(spark, d)
    found = rules.detect_findings(p)
    s = scoring.risk_scores(found, p).join(scoring.validation(found, p), "doc_id").join(p.select("doc_id", "context", rules.completeness(F.col("text")).alias("c")), "doc_id")
    sure = scoring.document_confidence(F.col("validation"), F.lit(None).cast("double"), False, F.lit(False), F.lit(0), F.lit(0))
    s = s.withColumn("readiness", scoring.action_readiness(F.col("risk_score"), sure, F.col("c")))
    v = scoring.verdict(F.col("context"), F.col("readiness"))
    return s.select("doc_id", "readiness", v["label"].alias("label"), v["headline"].alias("headline"))


_KEYED = "lower(category) AS k1, lower(substr(trim(excerpt), 1, 120)) AS k2"
_MERGED = f"""{views.SQL_MODEL}, kept AS (SELECT * FROM model WHERE len(legal_basis) > 0 AND len(jurisdictions) > 0), {_EVIDENCE},
r AS (SELECT *, {_KEYED} FROM evidence QUALIFY row_number() OVER (PARTITION BY doc_id, k1, k2 ORDER BY ord) = 1),
m AS (SELECT *, {_KEYED} FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, k1, k2 ORDER BY ord DESC) = 1),
merged AS (
  SELECT coalesce(r.doc_id, m.doc_id) AS doc_id, coalesce(r.category, m.category) AS category, coalesce(r.severity, m.severity) AS severity, r.ord IS NULL AS from_model, coalesce(r.ord, m.ord)::BIGINT AS ord,
    CASE WHEN r.ord IS NULL THEN m.confidence WHEN m.ord IS NULL THEN r.confidence ELSE 0.6 * r.confidence + 0.4 * m.confidence END::DOUBLE AS confidence,
    CASE WHEN r.ord IS NULL THEN m.irp_score WHEN m.ord IS NULL THEN r.irp_score ELSE greatest(0, round(0.5 * (r.impact / 5.0) + 0.4 * (r.likelihood / 5.0) - 0.3 * (m.safeguard_score / 5.0), 4))::DOUBLE END AS irp_score,
    m.ord IS NOT NULL AND CASE WHEN r.ord IS NULL THEN m.confidence ELSE 0.6 * r.confidence + 0.4 * m.confidence END < 0.6 AS needs_review,
    coalesce(r.excerpt, m.excerpt) AS excerpt, coalesce(r.line_start, m.line_start) AS line_start, coalesce(r.line_end, m.line_end) AS line_end, coalesce(r.jurisdictions, m.jurisdictions) AS jurisdictions, coalesce(r.legal_basis, m.legal_basis) AS legal_basis
  FROM r FULL JOIN m ON r.doc_id = m.doc_id AND r.k1 = m.k1 AND r.k2 = m.k2)"""


@query(f"WITH {_FINDINGS}, {_MERGED} SELECT doc_id, category, from_model, ord, needs_review, round(irp_score, 6)::DOUBLE AS irp_score, round(confidence, 6)::DOUBLE AS confidence FROM merged")
def j1_merge(spark, d):
    kept, _ = scoring.model_finding_filter(views.model_findings(spark, d))
    merged = scoring.merge_findings(rules.detect_findings(views.policies(spark, d)), kept)
    return merged.select("doc_id", "category", "from_model", F.col("ord").cast("long").alias("ord"), "needs_review", F.round("irp_score", 6).alias("irp_score"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {views.SQL_POLICIES}, b AS (SELECT doc_id // 20 AS batch, doc_id % 20 AS idx, doc_id, text FROM policies),
f AS ({' UNION ALL '.join(f"SELECT batch, idx, doc_id, {k} AS way, unnest(h) AS reference, unnest(range(len(h))) AS n FROM (SELECT *, regexp_extract_all(text, {_q('(?i)' + p)}) AS h FROM b)" for k, p in enumerate(catalog.REFERENCES))})
SELECT a.doc_id, c.doc_id AS target, way, n::BIGINT AS n, reference FROM f a JOIN b c ON a.batch = c.batch AND a.idx < c.idx""")
def j3_cross_refs(spark, d):
    b = views.policies(spark, d).select("doc_id", "text", F.floor(F.col("doc_id") / 20).alias("batch"), (F.col("doc_id") % 20).alias("idx"))
    return analysis.cross_references(b).select("doc_id", "target", "way", F.col("n").cast("long").alias("n"), "reference")


def _said(name: str, fold: str = "(?i)", plural: str = "") -> str:
    """Whether a name occurs between ASCII word boundaries."""
    spelt = "".join(c if c.isalnum() or c == " " or not c.isascii() else "\\" + c for c in name)
    pattern = (r"\b" if name[0].isalnum() else "") + spelt + plural + (r"\b" if name[-1].isalnum() else "")
    return f"regexp_matches(text, {_q(fold + pattern)})"


def _list(cases) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {hit} THEN {_q(code)} END" for hit, code in cases) + "], lambda x: x IS NOT NULL)"


_SB = "regexp_matches(text, '(?i)\\bSB\\s*205\\b')"
_LAWS = [(_SB if n == "SB 205" else _said(n), j) for n, j in catalog.STATUTES.items() if n != "SB205"] + [(f"({_said('CPA')} AND ({_said('Colorado')} OR {_said('C.R.S.')} OR {_SB}))", "US-CO")]
_CURRENCY = [(f"(contains(text, {_q(sign)}) AND regexp_matches(text, {_q('(?i)(' + '|'.join(phrases) + ')')}))", j) for sign, phrases, j in catalog.CURRENCIES]
_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)), '^www\\.', '')"
_SUFFIX = "CASE " + " ".join(f"WHEN ends_with(host, {_q(s)}) THEN {_q(j)}" for s, j in catalog.SUFFIXES.items()) + " END"
_EU = " + ".join(f"contains(lower(text), {_q(w)})::INT" for w in catalog.EU_WORDS)


@query(f"""WITH {views.SQL_POLICIES}, h AS (SELECT doc_id, {_HOST} AS host, text FROM policies),
f AS (SELECT doc_id, text, list_filter([{_SUFFIX}], lambda x: x IS NOT NULL) AS tld, {_list(_LAWS)} AS statute, {_list((_said(n, ''), j) for n, j in catalog.REGULATORS.items())} AS regulator,
  {_list((_said(n, plural='' if n == 'European Economic Area' else 's?'), j) for n, j in catalog.RESIDENTS.items())} AS geography, {_list(_CURRENCY)} AS currency FROM h),
g AS (SELECT *, tld || statute || regulator || geography || currency AS sure FROM f),
e AS (SELECT *, CASE WHEN len(sure) = 0 AND {_EU} >= 2 THEN ['GDPR'] ELSE sure END AS j FROM g)
SELECT doc_id, array_to_string(list_filter(j, lambda x, i: list_position(j, x) = i), ',') AS jurisdictions, len(j) = 0 AS location_needed, (len(tld) > 0)::INT + (len(statute) > 0)::INT + (len(regulator) > 0)::INT + (len(geography) > 0)::INT + (len(currency) > 0)::INT + (len(sure) = 0)::INT AS n_kinds FROM e""")
def i8_jurisdictions(spark, d):
    return inference.infer_all(views.policies(spark, d)).select("doc_id", F.array_join("jurisdictions", ",").alias("jurisdictions"), "location_needed", F.size("detected_signals").alias("n_kinds"))


_KNOWN_HOST = " ".join(f"WHEN {' OR '.join(f'host = {_q(h)} OR ends_with(host, {_q(chr(46) + h)})' for h in hosts)} THEN {_q(i)}" for i, hosts in catalog.HOST_INDUSTRIES.items())
_WORDY = " ".join(f"WHEN regexp_matches(lower(url || ' ' || text), {_q(_edges('(' + '|'.join(w) + ')'))}){' OR contains(host, ' + _q('.edu') + ')' if i == 'Education' else ''} THEN {_q(i)}" for i, w in catalog.INDUSTRIES.items())
_SPEAKS = {t: "(" + " OR ".join(f"contains(lower(text), {_q(x)})" for x in phrases) + ")" for t, phrases in catalog.TEXT_TYPES.items()}


@query(f"""WITH {views.SQL_POLICIES}, h AS (SELECT doc_id, url, {_HOST} AS host, lower(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)) AS path, text FROM policies)
SELECT doc_id, CASE {' '.join(f"WHEN contains(path, {_q(p)}) THEN {_q(t)}" for p, t in catalog.PATH_TYPES)} WHEN {_SPEAKS['Privacy Policy']} AND {_SPEAKS['Terms of Service']} THEN 'Combined'
  WHEN {_SPEAKS['Terms of Service']} THEN 'Terms of Service' ELSE 'Privacy Policy' END AS doc_type,
  CASE {_KNOWN_HOST} WHEN ends_with(host, '.gov') OR contains(host, '.gov.') THEN 'General' {_WORDY} ELSE 'General' END AS industry FROM h""")
def i9_i10_type_industry(spark, d):
    return inference.infer_all(views.policies(spark, d)).select("doc_id", "doc_type", "industry")


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host, lower(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1)) AS path, page_id % 7 <> 0 AS valid FROM pages""")
def i1_url_parts(spark, d):
    u = F.col("url")
    odd = F.when(F.col("page_id") % 14 == 0, F.regexp_replace(u, "^https?:", "ftp:")).when(F.col("page_id") % 7 == 0, F.regexp_replace(u, "^https?://", "")).otherwise(u)
    return views.table(spark, d, "pages").select("page_id", inference.url_host(u).alias("host"), inference.url_path(u).alias("path"), text.valid_url(odd).alias("valid"))


@query("SELECT doc_id, sha256(text) AS content_hash, length(text)::BIGINT AS n FROM documents")
def x3_content_hash(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("n"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS paste FROM documents")
def p2_paste(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.normalise_paste(F.col("text")).alias("paste"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: lpad(i::VARCHAR, 4, '0') || '| ' || x), chr(10)) AS numbered FROM documents""")
def x1_number_lines(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.number_lines(F.col("text")).alias("numbered"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, (i - 1)::BIGINT AS n, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS start FROM l, unnest(range(1, len(l) + 1)) AS t(i)""")
def x2_line_offsets(spark, d):
    return text.line_starts(views.table(spark, d, "documents")).select("doc_id", F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"))


@query()
def x7_chunks(spark, d):
    return text.chunk_text(views.policies(spark, d))


_TOKENS = r"""regexp_extract_all({}, '[\pL\pN\pM_]+|[.,:;!?"'']')"""


@query(f"""WITH {views.SQL_VERSIONS}, p AS (SELECT url, version, text, lag(text) OVER (PARTITION BY url ORDER BY captured_at, version) AS old_text FROM versions),
t AS (SELECT url, version, unnest({_TOKENS.format('text')}) AS token, 1 AS n FROM p WHERE version > 0 UNION ALL SELECT url, version, unnest({_TOKENS.format('old_text')}) AS token, -1 AS n FROM p WHERE version > 0)
SELECT url, version, token, sum(n)::BIGINT AS delta, CASE WHEN lower(token) IN ({', '.join(map(_q, catalog.CRITICAL_WORDS))}) THEN 'high' WHEN lower(token) IN ({', '.join(map(_q, catalog.MIDDLE_WORDS))}) THEN 'medium' ELSE 'low' END AS severity
FROM t GROUP BY url, version, token HAVING sum(n) <> 0""")
def d3_bag_diff(spark, d):
    return versions.token_bag_diff(versions.version_pairs(views.versions(spark, d)))


@query()
def d2_token_diff(spark, d):
    return versions.token_diff(versions.version_pairs(views.versions(spark, d)))


@query(f"""WITH {views.SQL_VERSIONS}, f AS (SELECT url, version, sha256(text) AS content_hash, row_number() OVER (PARTITION BY url, sha256(text) ORDER BY captured_at, version) AS n FROM versions WHERE version > 0)
SELECT url, version, content_hash FROM f WHERE n = 1 AND (url, content_hash) NOT IN (SELECT url, sha256(text) FROM versions WHERE version = 0)""")
def j5_dedup(spark, d):
    v = views.versions(spark, d)
    store = v.filter("version = 0").withColumn("content_hash", F.sha2("text", 256))
    return versions.dedup_snapshots(v.filter("version > 0"), store).select("url", "version", "content_hash")


@query(f"""WITH {views.SQL_VERSIONS}, w AS (SELECT url, sha256(text) AS last_hash, string_split(text, chr(10)) AS old FROM versions WHERE version = 0), n AS (SELECT url, sha256(text) AS hash FROM versions WHERE version = 1),
d AS (SELECT doc_id, last_hash, hash, doc_id % 4 <> 0 AND doc_id % 6 <> 0 AND (doc_id % 5 = 0 OR TIMESTAMP '2024-02-01 00:00:00' + to_seconds(doc_id % 7 * 3600 + 3600) <= TIMESTAMP '2024-02-01 05:00:00') AS due, doc_id % 3 <> 0 AS ok, doc_id % 2 = 0 AS scored
  FROM w JOIN n USING (url) JOIN documents ON w.url = 'https://site' || doc_id || '.com/privacy'),
s AS (SELECT *, due AND ok AS take, due AND ok AND last_hash <> hash AS updated FROM d)
SELECT doc_id AS id, CASE WHEN updated THEN 'Updated' WHEN take THEN 'No Changes' WHEN due THEN 'Check Failed' ELSE 'New' END AS status, CASE WHEN take THEN hash ELSE last_hash END AS last_hash,
  CASE WHEN take AND scored THEN round((doc_id % 90) / 10.0 - 4.0, 2) ELSE 0.0 END::DOUBLE AS risk_delta, CASE WHEN take THEN (doc_id % 90) / 10.0 WHEN scored THEN 4.0 END::DOUBLE AS last_risk,
  CASE WHEN due THEN '2024-02-01 05:00:00' WHEN doc_id % 5 <> 0 THEN strftime(TIMESTAMP '2024-02-01 00:00:00' + to_seconds(doc_id % 7 * 3600), '%Y-%m-%d %H:%M:%S') END AS last_checked, updated AS changed FROM s""")
def d5_watch(spark, d):
    i = F.col("doc_id")
    got = views.versions(spark, d).filter("version = 1").join(views.table(spark, d, "documents").select(views.page_url(i).alias("url"), (i % 3 != 0).alias("ok"), (i % 90 / 10.0).alias("risk")), "url").select("url", "text", "ok", "risk")
    after = versions.watch_refresh(views.watched(spark, d), got, F.lit("2024-02-01 05:00:00").cast("timestamp"))
    return after.select("id", "status", "last_hash", F.col("risk_delta").cast("double").alias("risk_delta"), F.col("last_risk").cast("double").alias("last_risk"), F.date_format("last_checked", "yyyy-MM-dd HH:mm:ss").alias("last_checked"), (F.col("change_count") > 0).alias("changed"))


_BM25 = r"""tok AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\pL\pN\pM_]+') AS w FROM documents),
tf AS (SELECT chunk_id, word, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS word FROM tok) GROUP BY 1, 2),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean_len FROM tok),
raw AS (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT word, count(*) AS df FROM tf GROUP BY word), s),
idf AS (SELECT word, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, word, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\pL\pN\pM_]+')) AS word FROM benchmark) GROUP BY 1, 2),
bm AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean_len))) AS score FROM q JOIN idf USING (word) JOIN tf USING (word) JOIN tok USING (chunk_id), s GROUP BY 1, 2)"""


def _chunks(spark, d):
    """Documents as chunks, each with a vector of the given table."""
    v = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    n = v.count()
    i = F.col("doc_id")
    return rules.spread(views.table(spark, d, "documents")).select(i.alias("chunk_id"), "text", views.pick(views.JURISDICTIONS, i).alias("jurisdiction"), (i % n).alias("v")).join(v, "v")


def _asked(spark, d):
    v = views.table(spark, d, "embeddings").select((F.col("vec_id") - 7).alias("query_id"), F.col("embedding").alias("vector"))
    none = F.array().cast("array<string>")
    codes = F.when(F.col("item_id") % 3 == 0, none).when(F.col("item_id") % 3 == 1, F.array(F.lit("gdpr"))).otherwise(F.array(F.lit("US-CA"), F.lit("nowhere")))
    return views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", codes.alias("codes")).join(v, "query_id")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 4) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, chunk_id) <= 5")
def r1_bm25(spark, d):
    chunks = rules.spread(views.table(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), "text", F.lit("").alias("jurisdiction"), F.lit(None).cast("array<double>").alias("vector"))
    asked = views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.array().cast("array<string>").alias("codes"))
    return search_index.write_index(chunks, scratch(spark, "index")).bm25_top(asked, 5, digits=4).select("query_id", "chunk_id", "score")


_DENSE = """v AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT label AS query_id, embedding AS qv FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
dot AS (SELECT query_id, vec_id AS chunk_id, round(list_sum(list_transform(range(1, 65), lambda i: qv[i]::DOUBLE * embedding[i]::DOUBLE)), 6) AS score FROM q, v)"""


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, score FROM dot QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5")
def r2_dense(spark, d):
    from pyspark.sql import Window

    v = views.table(spark, d, "embeddings")
    first = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    none = F.array().cast("array<string>")
    q = v.withColumn("k", first).filter("k = 1").select(F.col("label").cast("long").alias("query_id"), F.lit("").alias("text"), none.alias("codes"), F.col("embedding").cast("array<double>").alias("vector"))  # a query per label
    chunks = v.select(F.col("vec_id").alias("chunk_id"), F.lit("").alias("text"), F.lit("").alias("jurisdiction"), F.col("embedding").alias("vector"))
    return retrieval.Ranker(chunks, q).best(5, ("dense",)).select(F.col("query_id").cast("int").alias("query_id"), "chunk_id", "score")


_RETRIEVE = r"""chunk AS (SELECT doc_id AS chunk_id, text, lower(""" + views.sql_pick(views.JURISDICTIONS, "doc_id") + r""") AS code, embedding AS vector FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
asked AS (SELECT item_id AS query_id, text, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'gdpr' ELSE 'us-ca' END AS code, embedding AS vector FROM benchmark JOIN embeddings ON vec_id = item_id + 7),
pool AS (SELECT DISTINCT a.code AS pool, c.chunk_id, regexp_extract_all(lower(c.text), '[\pL\pN\pM_]+') AS w FROM (SELECT DISTINCT code FROM asked) a JOIN chunk c ON a.code = '' OR a.code = c.code),
s AS (SELECT pool, count(*) AS n, avg(len(w)) AS mean_len FROM pool GROUP BY pool),
tf AS (SELECT pool, chunk_id, word, count(*) AS tf FROM (SELECT pool, chunk_id, unnest(w) AS word FROM pool) GROUP BY 1, 2, 3),
raw AS (SELECT pool, word, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT pool, word, count(*) AS df FROM tf GROUP BY 1, 2) JOIN s USING (pool)),
idf AS (SELECT pool, word, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY pool) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, code AS pool, word, count(*) AS times FROM (SELECT query_id, code, unnest(regexp_extract_all(lower(text), '[\pL\pN\pM_]+')) AS word FROM asked) GROUP BY 1, 2, 3),
sparse AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean_len))) AS score FROM q JOIN idf USING (pool, word) JOIN tf USING (pool, word) JOIN pool USING (pool, chunk_id) JOIN s USING (pool) GROUP BY 1, 2),
norm AS (SELECT query_id, code, list_transform(vector, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(vector, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM asked),
both_ AS (SELECT a.query_id, c.chunk_id, round(coalesce(sparse.score, 0), 6) AS sparse, round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * c.vector[i]::DOUBLE)), 6) AS dense
  FROM norm a JOIN chunk c ON a.code = '' OR a.code = c.code LEFT JOIN sparse ON sparse.query_id = a.query_id AND sparse.chunk_id = c.chunk_id),
ranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, chunk_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS b FROM both_),
fused AS (SELECT query_id, chunk_id, round(1.0 / (60 + a) + 1.0 / (60 + b), 6)::DOUBLE AS score FROM ranked)"""


@query(f"WITH {_RETRIEVE} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM fused QUALIFY rank <= 5")
def r4_retrieve(spark, d):
    return retrieval.retrieve(_asked(spark, d), _chunks(spark, d)).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_RETRIEVE} SELECT query_id, chunk_id, score FROM fused WHERE query_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20""")
def w6_rrf(spark, d):
    """BM25 and dense ranks fused, over the whole corpus."""
    every = _asked(spark, d).filter("size(codes) = 0")
    return retrieval.retrieve(every, _chunks(spark, d), 20).select("query_id", "chunk_id", "score")


_OWN_BM25 = r"""c AS (SELECT doc_id AS corpus, k AS chunk_id, line AS text, length(line) AS len, regexp_extract_all(lower(line), '[\pL\pN\pM_]+') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM policies)),
s AS (SELECT corpus, count(*) AS n, avg(len(w)) AS mean_len FROM c GROUP BY corpus),
tf AS (SELECT corpus, chunk_id, word, count(*) AS tf FROM (SELECT corpus, chunk_id, unnest(w) AS word FROM c) GROUP BY 1, 2, 3),
raw AS (SELECT corpus, word, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT corpus, word, count(*) AS df FROM tf GROUP BY 1, 2) JOIN s USING (corpus)),
idf AS (SELECT corpus, word, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY corpus) ELSE raw END AS idf FROM raw),
bm AS (SELECT corpus, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean_len))), 4) AS score FROM idf JOIN tf USING (corpus, word) JOIN c USING (corpus, chunk_id) JOIN s USING (corpus) WHERE word IN ('data', 'rights', 'terms', 'your') GROUP BY 1, 2),
a AS (SELECT corpus, chunk_id, row_number() OVER (PARTITION BY corpus ORDER BY score DESC, chunk_id) AS rank FROM bm),
u AS (SELECT a.corpus, a.chunk_id, sum(len) OVER (PARTITION BY a.corpus ORDER BY rank) AS upto FROM a JOIN c USING (corpus, chunk_id))"""


@query(f"WITH {views.SQL_POLICIES}, {_OWN_BM25} SELECT corpus AS doc_id, chunk_id, upto::BIGINT AS upto FROM u WHERE upto <= 200")
def w7_budget(spark, d):
    """The lines of each policy that fit best to a question, as far as they fit in 200 characters; each policy is a corpus of its own."""
    own = views.policies(spark, d).select(F.col("doc_id").alias("corpus"), F.split("text", "\n", -1).alias("lines"), F.lit("data rights terms your").alias("asked"))
    each = retrieval.with_own_bm25(own, "lines", "asked").select("corpus", F.posexplode(F.arrays_zip("lines", "bm25")).alias("chunk_id", "x")).filter("x.bm25 is not null")
    ranked = retrieval.ranks(each.select("corpus", "chunk_id", F.round("x.bm25", 4).alias("score"), F.length("x.lines").alias("len")), ("corpus",))
    return retrieval.budget(ranked, "len", 200, ("corpus",)).select(F.col("corpus").alias("doc_id"), F.col("chunk_id").cast("long").alias("chunk_id"), "upto")


@query(f"""WITH {views.SQL_ROLLUPS}, a AS (SELECT * FROM (SELECT DISTINCT industry FROM rollups), (SELECT DISTINCT jurisdiction FROM rollups))
SELECT industry, jurisdiction, round(coalesce(avg(crs), 0), 6) AS mean, count(crs) AS n FROM a LEFT JOIN rollups USING (industry, jurisdiction) GROUP BY 1, 2""")
def a7_heatmap(spark, d):
    return rollups.heatmap(views.rollups(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {views.SQL_ROLLUPS} SELECT count(*) AS n, round(avg(crs), 6) AS mean, round(100.0 * count(*) FILTER (crs >= 0.7) / count(*), 6)::DOUBLE AS percent_red, round(100.0 * count(*) FILTER (crs >= 0.75) / count(*), 6)::DOUBLE AS percent_high, count(*) FILTER (minors) AS n_minors, (SELECT category FROM rollups GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS top_category FROM rollups")
def a8_kpis(spark, d):
    return rollups.kpis(views.rollups(spark, d)).withColumns({"mean": F.round("mean", 6), "percent_red": F.round(F.col("percent_red").cast("double"), 6), "percent_high": F.round(F.col("percent_high").cast("double"), 6)})


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word")
def a10_keywords(spark, d):
    return rollups.keyword_frequency(views.table(spark, d, "documents"))


@query("""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), a AS (SELECT word, count(*) AS x FROM w WHERE lang = 'en' GROUP BY word), b AS (SELECT word, count(*) AS y FROM w WHERE lang <> 'en' GROUP BY word),
j AS (SELECT coalesce(x, 0)::DOUBLE AS x, coalesce(y, 0)::DOUBLE AS y FROM a FULL JOIN b USING (word))
SELECT round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) < 0.7 AS drift FROM j""")
def a11_drift(spark, d):
    t = views.table(spark, d, "documents")
    return rollups.distribution_drift(rollups.keyword_frequency(t.filter("lang = 'en'")), rollups.keyword_frequency(t.filter("lang <> 'en'"))).withColumn("cosine", F.round("cosine", 6))


_CATS = sorted({r.category for r in RULES})
_GOLD = " UNION ALL ".join(f"SELECT doc_id, {_q(RULES[k % len(RULES)].category)} AS category FROM documents WHERE (doc_id * 7 + {k * 13}) % 11 < 3" for k in range(len(CLAUSES)))


def _gold(docs):
    """doc_id, category: what the planted clauses are about, whatever the scan finds."""
    chosen = F.filter(F.array(*[F.when(F.pmod(F.col("doc_id") * 7 + k * 13, F.lit(11)) < 3, RULES[k % len(RULES)].category) for k in range(len(CLAUSES))]), lambda x: x.isNotNull())
    return docs.select("doc_id", F.explode(chosen).alias("category"))


_SCORES = f"""g AS (SELECT DISTINCT doc_id, category FROM ({_GOLD})), p AS (SELECT DISTINCT doc_id, category FROM findings),
x AS (SELECT category, count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL)::DOUBLE AS tp, count(*) FILTER (g.doc_id IS NULL)::DOUBLE AS fp, count(*) FILTER (p.doc_id IS NULL)::DOUBLE AS fn FROM g FULL JOIN p USING (doc_id, category) GROUP BY category),
c AS (SELECT *, n - tp - fp - fn AS tn FROM (SELECT r.category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, (SELECT count(*) FROM documents)::DOUBLE AS n FROM (SELECT DISTINCT category FROM rules) r LEFT JOIN x USING (category))),
k AS (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS chance FROM c),
pooled AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(n) AS n FROM c),
pool AS (SELECT (tp + tn) / n AS seen, (tp + fn) / n * (tp + fp) / n + (fp + tn) / n * (fn + tn) / n AS chance FROM pooled)"""


@query(f"""WITH {_FINDINGS}, g AS (SELECT DISTINCT doc_id, category FROM ({_GOLD})), p AS (SELECT DISTINCT doc_id, category FROM findings),
x AS (SELECT category, count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM g FULL JOIN p USING (doc_id, category) GROUP BY category),
c AS (SELECT *, (SELECT count(*) FROM documents) - tp - fp - fn AS tn, (SELECT count(*) FROM documents)::DOUBLE AS n FROM x),
k AS (SELECT *, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / (n * n) AS e FROM c)
SELECT category, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall, round(2.0 * tp / greatest(1, 2 * tp + fp + fn), 6)::DOUBLE AS f1, round(CASE WHEN e >= 1 THEN 0.0 ELSE ((tp + tn) / n - e) / (1 - e) END, 6)::DOUBLE AS kappa FROM k""")
def a14_kappa(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id")
    s = rollups.scores(rollups.confusion(_gold(docs), rules.rule_hits(views.policies(spark, d)), docs, _CATS))
    return s.select("category", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), F.round("kappa", 6).alias("kappa"))


@query(f"WITH {views.SQL_ROLLUPS} SELECT date_trunc('day', ts) AS start, count(*) AS n, sum(crs::DECIMAL(18, 10))::DOUBLE / count(crs) AS mean FROM rollups GROUP BY 1")
def d11_daily_kpis(spark, d):
    return streams.stream_kpis(views.rollups(spark, d)).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean")


@query()
def s4_html_text(spark, d):
    return readers.html_to_text(views.table(spark, d, "pages"))


@query(f"""WITH {_FINDINGS}, {_EVIDENCE} SELECT doc_id AS analysis_id, 'policy ' || doc_id AS document_name, doc_id || '-' || (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) AS finding_id, category, severity, printf('%.2f', confidence) AS confidence,
  replace(excerpt, chr(10), ' ') AS excerpt, line_start, line_end FROM evidence""")
def s8_findings_csv(spark, d):
    rows = readers.findings_csv_rows(rules.detect_findings(views.policies(spark, d)), views.analyses(spark, d))
    return rows.withColumns({"line_start": F.col("line_start").cast("long"), "line_end": F.col("line_end").cast("long")})
