"""Views derived from the given tables: policies, their versions, model findings and roll-up rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import CLAUSES, CONTEXT_PRIORITY, RULES
from ..operators.rules import spread

DOC_TYPES = ["Privacy Policy", "Terms of Service", "Cookie Policy", "Combined"]
INDUSTRIES = ["General", "Healthcare", "Finance", "Education", "Retail"]
JURISDICTIONS = ["US-CA", "GDPR", "UK-GDPR", "US-FED"]


def pick(values: list[str], n):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _clauses(seed):
    chosen = [F.when(F.pmod(seed + k * 13, F.lit(11)) < 3, F.lit(c)) for k, c in enumerate(CLAUSES)]
    return F.concat_ws("\n", *chosen)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with clauses appended, dealt over all cores, as scanning them is long work."""
    d, i = spread(table(spark, sf_dir, "documents")), F.col("doc_id")
    return d.select(
        "doc_id", F.concat("text", F.lit("\n"), _clauses(i * 7)).alias("text"), F.col("source").alias("vendor"), "lang",
        pick(DOC_TYPES, i).alias("doc_type"), pick(INDUSTRIES, i).alias("industry"), pick(JURISDICTIONS, i).alias("jurisdiction"),
        F.array(pick(CONTEXT_PRIORITY, i), pick(CONTEXT_PRIORITY, F.floor(i / 5))).alias("context"),
        F.concat(F.lit("https://www."), "source", F.when(i % 3 == 0, ".co.uk/privacy").when(i % 3 == 1, ".de/terms").otherwise(".com/about")).alias("url"),
    )


def page_url(i):
    return F.concat(F.lit("https://site"), i.cast("string"), F.lit(".com/privacy"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four versions of each document, its whole text with a note in the middle and clauses; one page in five repeats version 1 as version 2."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(*map(F.lit, range(4)))).alias("version"))
    shown = F.when((F.col("doc_id") % 5 == 0) & (F.col("version") == 2), 1).otherwise(F.col("version"))
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), half), F.lit(" edition "), shown.cast("string"), F.lit("; "), F.substring("text", half + 1, F.length("text")), F.lit("\n"), _clauses(F.col("doc_id") * 7 + shown * 5))
    return d.select(page_url(F.col("doc_id")).alias("url"), "version", F.date_add(F.lit("2024-01-01").cast("date"), F.col("version")).alias("captured_at"), text.alias("text"))


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), pick(INDUSTRIES, F.col("user_id")).alias("industry"), pick(JURISDICTIONS, F.floor(F.col("user_id") / 5)).alias("jurisdiction"),
        (F.col("user_id") % 2 == 0).alias("minors"), F.least(F.lit(1.0), F.col("value") / 100).alias("crs"), F.col("event_type").alias("category"), (F.col("user_id") % 3 > 0).alias("optin"),
    )


def model_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model might have said: the clauses with even numbers, under their number's category; one in nine without legal basis, one in thirteen without jurisdiction."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(0, len(CLAUSES), 2)))).alias("ord"))
    cats = [r.category for r in RULES]
    i, none = F.col("doc_id") + F.col("ord"), F.array().cast("array<string>")
    return d.filter((F.col("doc_id") * 7 + F.col("ord") * 13) % 11 < 3).select(
        "doc_id", "ord", pick(cats, F.col("ord")).alias("category"), F.lit("Medium").alias("severity"), ((F.col("doc_id") * 31 + F.col("ord") * 17) % 100 / 100.0).alias("confidence"),
        pick(CLAUSES, F.col("ord")).alias("excerpt"), F.lit("said by a model").alias("explanation"), F.when(i % 13 == 0, none).otherwise(F.array(pick(JURISDICTIONS, i))).alias("jurisdictions"),
        F.when(i % 9 == 0, none).otherwise(F.array(F.lit("GDPR 6"))).alias("legal_basis"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
        F.lit(3).alias("impact"), F.lit(3).alias("likelihood"), F.lit(1).alias("safeguard_score"), F.lit(0.48).alias("irp_score"),
    )


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else the model said of a document: a summary of three in four, and how sure it is."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, "short").alias("summary"), ((F.col("doc_id") * 37) % 100 / 100.0).alias("overall_confidence"))


def model_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, body: a document's model findings as the JSON a model returns, with what models get wrong.

    By (5 doc_id + ord) mod 13: 0 a number out of its range, 1 no object, 2 a fraction, 3 a field missing, 4 a number as
    a string, 5 a key twice, 6 evidence that is a list, 7 another type, 8 an unknown jurisdiction. One body in 17 is cut
    off, one in 19 is a list.
    """
    m, way = model_findings(spark, sf_dir), (F.col("doc_id") * 5 + F.col("ord")) % 13
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    fields = [
        F.when(way == 7, '"category":7').otherwise(F.concat(F.lit('"category":'), quoted("category"))),
        F.when(way == 5, '"severity":"Odd","severity":"Medium"').otherwise('"severity":"Medium"'),
        F.concat(F.lit('"confidence":'), F.when(way == 0, "1.5").otherwise(F.col("confidence").cast("string"))),
        F.when(way != 3, F.concat(F.lit('"excerpt":'), quoted("excerpt"))), F.lit('"explanation":"said by a model"'),
        F.concat(F.lit('"jurisdictions":'), F.when(way == 8, '["Nowhere"]').otherwise(F.to_json("jurisdictions"))),
        F.when(way == 6, '"evidence":[1]').otherwise(F.concat(F.lit('"evidence":{"line_start":1,"line_end":1,"legal_basis":'), F.to_json("legal_basis"), F.lit("}"))),
        F.concat(F.lit('"impact":'), F.when(way == 2, "2.5").when(way == 4, '"4"').otherwise("3")), F.lit('"likelihood":3,"safeguard_score":1'),
    ]
    item = F.when(way == 1, '"nothing found"').otherwise(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("f")))), lambda x: x["f"]), ",")
    whole = F.concat(F.when(F.col("doc_id") % 19 == 0, "[").otherwise('{"findings":['), items, F.when(F.col("doc_id") % 17 == 0, "").when(F.col("doc_id") % 19 == 0, "]").otherwise("]}"))
    return m.groupBy("doc_id").agg(whole.alias("body"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of finished analyses, made from the documents' ids, for listings and portfolios."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat(F.lit("policy "), i.cast("string")).alias("name"), pick(DOC_TYPES, i).alias("doc_type"), page_url(i).alias("url"), F.col("source").alias("vendor"), F.when(i % 3 == 0, "needs_review").otherwise("completed").alias("status"),
        (i * 7 % 100 / 100.0).alias("confidence"), (i * 13 % 1000 / 100.0).alias("risk_score"), pick(["A", "B", "C"], i).alias("grade"), F.timestamp_seconds(1_700_000_000 + i * 61).alias("created_at"),
    )


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch item for each document, as after version 0."""
    v = versions(spark, sf_dir).filter("version = 0")
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("id"), page_url(i).alias("source_url"), (i % 4 != 0).alias("enabled"), F.when(i % 6 != 0, 3600).alias("check_frequency"), F.when(i % 5 != 0, F.timestamp_seconds(1_706_745_600 + i % 7 * 3600)).alias("last_checked"))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    return d.join(v.select(F.col("url").alias("source_url"), F.sha2("text", 256).alias("last_hash"), F.col("text").alias("last_text")), "source_url").select(
        "id", "source_url", "enabled", "check_frequency", "last_checked", F.lit("New").alias("status"), none("timestamp", "changes_since"), F.lit(0).alias("change_count"), F.lit("").alias("change_summary"),
        "last_hash", F.lit(0.0).alias("risk_delta"), F.when(F.col("id") % 2 == 0, 4.0).alias("last_risk"), "last_text",
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_pick(values: list[str], n: str) -> str:
    return f"list_extract([{', '.join(map(_q, values))}], (({n}) % {len(values)} + 1)::BIGINT)"


def sql_clauses(seed: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"CASE WHEN ({seed} + {k * 13}) % 11 < 3 THEN {_q(c)} END" for k, c in enumerate(CLAUSES)) + ")"


SQL_POLICIES = f"""policies AS (
  SELECT doc_id, text || chr(10) || {sql_clauses('doc_id * 7')} AS text, source AS vendor, lang, {sql_pick(DOC_TYPES, 'doc_id')} AS doc_type,
    {sql_pick(INDUSTRIES, 'doc_id')} AS industry, {sql_pick(JURISDICTIONS, 'doc_id')} AS jurisdiction,
    [{sql_pick(CONTEXT_PRIORITY, 'doc_id')}, {sql_pick(CONTEXT_PRIORITY, 'doc_id // 5')}] AS context,
    'https://www.' || source || CASE doc_id % 3 WHEN 0 THEN '.co.uk/privacy' WHEN 1 THEN '.de/terms' ELSE '.com/about' END AS url
  FROM documents)"""
SQL_VERSIONS = f"""versions AS (
  SELECT 'https://site' || doc_id || '.com/privacy' AS url, v::INT AS version, (DATE '2024-01-01' + v::INT)::DATE AS captured_at,
    substr(t, 1, length(t) // 2) || ' edition ' || s || '; ' || substr(t, length(t) // 2 + 1) || chr(10) || {sql_clauses('doc_id * 7 + s * 5')} AS text
  FROM (SELECT doc_id, coalesce(text, '') AS t, v, CASE WHEN doc_id % 5 = 0 AND v = 2 THEN 1 ELSE v END AS s FROM documents, range(0, 4) AS t(v)))"""
SQL_ROLLUPS = f"""rollups AS (
  SELECT ts, {sql_pick(INDUSTRIES, 'user_id')} AS industry, {sql_pick(JURISDICTIONS, 'user_id // 5')} AS jurisdiction, user_id % 2 = 0 AS minors, least(1.0, value / 100) AS crs, event_type AS category, user_id % 3 > 0 AS optin FROM events)"""
SQL_MODEL = f"""model AS (
  SELECT doc_id, o AS ord, {sql_pick([r.category for r in RULES], 'o')} AS category, 'Medium' AS severity, ((doc_id * 31 + o * 17) % 100) / 100.0 AS confidence,
    {sql_pick(CLAUSES, 'o')} AS excerpt, CASE WHEN (doc_id + o) % 13 = 0 THEN [] ELSE [{sql_pick(JURISDICTIONS, '(doc_id + o)')}] END::VARCHAR[] AS jurisdictions,
    CASE WHEN (doc_id + o) % 9 = 0 THEN [] ELSE ['GDPR 6'] END::VARCHAR[] AS legal_basis, 1 AS line_start, 1 AS line_end, 3 AS impact, 3 AS likelihood, 1 AS safeguard_score, 0.48::DOUBLE AS irp_score
  FROM documents, range(0, {len(CLAUSES)}, 2) AS t(o) WHERE (doc_id * 7 + o * 13) % 11 < 3)"""
SQL_ANALYSES = f"""analyses AS (
  SELECT doc_id, 'policy ' || doc_id AS name, {sql_pick(DOC_TYPES, 'doc_id')} AS doc_type, 'https://site' || doc_id || '.com/privacy' AS url, source AS vendor, CASE WHEN doc_id % 3 = 0 THEN 'needs_review' ELSE 'completed' END AS status,
    (doc_id * 7 % 100) / 100.0 AS confidence, (doc_id * 13 % 1000) / 100.0 AS risk_score, {sql_pick(['A', 'B', 'C'], 'doc_id')} AS grade, to_timestamp(1700000000 + doc_id * 61) AT TIME ZONE 'UTC' AS created_at FROM documents)"""
