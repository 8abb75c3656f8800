"""Listings, exports, reviews and checks over tables of analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog


def latest_analyses(analyses: DataFrame, n: int = 25) -> DataFrame:
    """The newest analyses, 1 to 200."""
    if not 1 <= n <= 200:
        raise ValueError("n is 1 to 200")
    return analyses.select("doc_id", "name", "doc_type", "url", "status", "confidence", "risk_score", "grade", "created_at").orderBy(F.desc("created_at"), "doc_id").limit(n)


def summary_csv_rows(analyses: DataFrame) -> DataFrame:
    """The nine columns of the summary export, numbers with two decimals; sort by created_at, descending, when writing."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    two = lambda c: F.format_string("%.2f", F.coalesce(c, F.lit(0.0))).alias(c)
    return analyses.select("doc_id", text("name"), text("doc_type"), text("url"), "status", two("confidence"), two("risk_score"), "grade", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


def batch_summary(analyses: DataFrame) -> DataFrame:
    return analyses.select("doc_id", "name", "url", "grade", "risk_score", "verdict_headline", "verdict_label", F.col("n_findings").alias("num_findings"), F.col("n_high").alias("num_high"), F.col("n_medium").alias("num_medium"), F.col("n_low").alias("num_low"))


def export_json(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, json: each row as a whole; write with .write.text() or as a column."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def redact_document_text(analyses: DataFrame) -> DataFrame:
    return analyses.withColumn("document_text", F.lit(None).cast("string"))


def report_sections(findings: DataFrame) -> DataFrame:
    """doc_id, severity, n, place, category, confidence in percent, excerpt of 500 characters at most, legal_basis: findings by severity."""
    n = findings.groupBy("doc_id", "severity").agg(F.count("*").alias("n"))
    return findings.join(n, ["doc_id", "severity"]).select(
        "doc_id", "severity", "n", "ord", "category", F.format_string("%.0f%%", F.bround(F.col("confidence") * 100, 0)).alias("confidence"), F.substring("excerpt", 1, 500).alias("excerpt"), F.array_join("legal_basis", ", ").alias("legal_basis")
    )


def filter_findings(findings: DataFrame, category: str = "All", severity: str = "All") -> DataFrame:
    out = findings if category == "All" else findings.filter(F.col("category") == category)
    return out if severity == "All" else out.filter(F.col("severity") == severity)


def filter_rollups(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns have the wanted values; 'All' wants any."""
    for column, value in wanted.items():
        if value != "All":
            rows = rows.filter(F.col(column) == value)
    return rows


def pending_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.filter("status = 'pending'")


def update_reviews(reviews: DataFrame, decisions: DataFrame, now) -> DataFrame:
    """The reviews with the status and notes of decisions(id, status, notes), one a review; the others stay as they are."""
    d = decisions.select("id", F.col("status").alias("_status"), F.col("notes").alias("_notes"), F.lit(True).alias("_decided"))
    decided = F.coalesce("_decided", F.lit(False))
    j = reviews.join(d, "id", "left")
    return j.select(
        *[c for c in reviews.columns if c not in ("status", "notes", "updated_at")], F.when(decided, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(decided, F.col("_notes")).otherwise(F.col("notes")).alias("notes"), F.when(decided, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def remove_items(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def catalog_guard(used: DataFrame, known: DataFrame, key: str = "category") -> DataFrame:
    """Keys in use that the catalogue doesn't know."""
    return used.select(key).distinct().join(known.select(key), key, "left_anti")


def rubric_scores(analyses: DataFrame) -> DataFrame:
    """One row of portfolio scores, 0 to 10, from the mean risk and confidence and the share of reviews; none for an empty table."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(10.0), x))
    s = analyses.agg(F.count("*").alias("n"), F.avg(F.coalesce("risk_score", F.lit(0.0))).alias("risk"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("sure"), F.avg((F.col("status") == "needs_review").cast("double")).alias("rate")).filter("n > 0")
    s = s.select(clamp(10 - F.col("risk")).alias("base"), clamp(F.col("sure") * 10).alias("conf"), clamp(10 - F.col("rate") * 10).alias("rev"), clamp(8.5 * F.col("sure") + 1.5 * (1 - F.col("rate"))).alias("ai"))
    mix = lambda **w: clamp(sum(F.col(c) * x for c, x in w.items()))
    # What each score is made of, and its share of the overall one.
    parts = {
        "product_integrity": (mix(base=1.0), 0.20), "legal_signal_quality": (mix(conf=1.0), 0.20), "ai_law_signal_quality": (F.col("ai"), 0.10), "privacy_security": (mix(base=0.9, conf=0.1), 0.10),
        "accessibility_usability": (mix(rev=0.6, conf=0.4), 0.15), "visual_design": (mix(rev=0.5, base=0.5), 0.10), "performance_reliability": (mix(rev=0.7, base=0.3), 0.10), "governance_readiness": (mix(rev=1.0), 0.05),
    }
    each = s.select(*[c.alias(k) for k, (c, _) in parts.items()])
    return each.withColumn("overall", clamp(sum(F.col(k) * w for k, (_, w) in parts.items())))


#: Jurisdictions of a place: states of one country, and whole countries; a parameter of location_to_jurisdictions().
STATES = {"California": "US-CA", "Colorado": "US-CO", "Connecticut": "US-CT", "New York": "US-NY", "Texas": "US-TX", "Virginia": "US-VA", "Illinois": "US-IL"}
COUNTRIES = {
    "Germany": "GDPR", "France": "GDPR", "Spain": "GDPR", "Italy": "GDPR", "Netherlands": "GDPR", "Ireland": "GDPR", "Sweden": "GDPR", "Poland": "GDPR", "United Kingdom": "UK-GDPR", "Canada": "PIPEDA", "Brazil": "LGPD",
    "Australia": "APP", "Japan": "APPI", "South Korea": "PIPA", "South Africa": "POPIA", "India": "DPDP",
}


def location_to_jurisdictions(country, state, states: dict = STATES, countries: dict = COUNTRIES, federal: tuple = ("United States", "US-FED")):
    """Array of codes: a state and its federation, the federation only, a country's, or none."""
    table = lambda t, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), c)
    own, code = table(states, state), table(countries, country)
    return F.when(country == federal[0], F.when(own.isNull(), F.array(F.lit(federal[1]))).otherwise(F.array(own, F.lit(federal[1])))).otherwise(F.when(code.isNull(), F.array().cast("array<string>")).otherwise(F.array(code)))


#: Languages for which the European model is meant.
EU_LANGUAGES = [
    "bg", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "ga", "hr", "hu", "it", "lt", "lv", "mt", "nl", "pl", "pt", "ro", "sk", "sl", "sv",
]


def route_model(lang, european: str = "eu", world: str = "world"):
    return F.when(F.lower(lang).isin(EU_LANGUAGES), european).otherwise(world)


def batch_jurisdictions(rows: DataFrame) -> DataFrame:
    """batch, codes: distinct codes of a batch that aren't blank, in the order of their first row; a batch has few codes."""
    code = rows.select("batch", "idx", F.trim("jurisdiction").alias("code")).filter("code <> ''")
    first = code.groupBy("batch", "code").agg(F.min("idx").alias("idx"))
    got = first.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "code"))), lambda x: x["code"]).alias("codes"))
    return rows.select("batch").distinct().join(got, "batch", "left").select("batch", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def prompt_rows(docs: DataFrame, findings: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, prompt: numbered text, the findings and the passages of each document; passages with a placeholder status are marked.

    passages(doc_id, rank, law, section, text, placeholder).
    """
    from ..functions.text import number_lines

    line = F.concat(F.lit("- "), F.col("category"), F.lit(" ("), F.col("severity"), F.lit("): "), F.col("excerpt"))
    f = findings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("findings"))
    mark = F.when(F.col("placeholder"), "UNVERIFIED ").otherwise("")
    passage = F.concat(F.lit("["), mark, F.col("law"), F.lit(", "), F.col("section"), F.lit("] "), F.col("text"))
    p = passages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", passage.alias("line")))), lambda x: x["line"]), "\n").alias("passages"))
    j = docs.select("doc_id", number_lines(F.coalesce("text", F.lit(""))).alias("numbered")).join(f, "doc_id", "left").join(p, "doc_id", "left")
    return j.select("doc_id", F.concat(F.lit("Findings:\n"), F.coalesce("findings", F.lit("none")), F.lit("\nLaw:\n"), F.coalesce("passages", F.lit("none")), F.lit("\nText:\n"), F.col("numbered")).alias("prompt"))


def known_categories(spark) -> DataFrame:
    names = sorted(set(catalog.IRP) | set(catalog.DOMAINS))
    return spark.createDataFrame([(c,) for c in names], "category string")
