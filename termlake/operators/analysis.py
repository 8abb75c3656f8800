"""The whole analysis of a table of documents, and references between the documents of a batch.

Documents with equal texts are one class. A class is scanned once, and its findings, checked against its text, come as one
array; the documents join that array by the hash of their text, with what a model said of each. From there every finding
is shuffled once, by document: merging, order, checks, scores and advice are taken from one array per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.catalog import RULES, Rule
from ..functions.text import line_offsets
from ..sources.store import written
from . import scoring
from .advice import ADVICE_FOR, advice_lines
from .rules import completeness, detect_findings, detect_quick, irp, java

#: Columns of a finding, as rules and models give them.
_FIELDS = "category severity confidence excerpt explanation jurisdictions legal_basis line_start line_end impact likelihood safeguard_score irp_score".split()
_KINDS = {
    "confidence": "double", "jurisdictions": "array<string>", "legal_basis": "array<string>", "line_start": "int", "line_end": "int", "impact": "int", "likelihood": "int",
    "safeguard_score": "int", "irp_score": "double",
}
#: A list of checked findings.
_SAID = "array<struct<ord:bigint," + ",".join(f"{c}:{_KINDS.get(c, 'string')}" for c in _FIELDS) + ",covered:boolean,beyond:boolean>>"


def _rule_findings(docs: DataFrame, quick: bool, rules: list[Rule], codes: list[str] | None, carry: tuple = ()) -> DataFrame:
    if not quick:
        return detect_findings(docs, rules, codes, carry)
    q = detect_quick(docs, rules, codes, carry)
    # one number in the order of rules, patterns and matches; the parts are bounded by the catalogue and the text
    return q.withColumn("ord", F.col("ord").cast("long") * (1 << 40) + F.col("pattern").cast("long") * (1 << 32) + F.col("n")).drop("pattern", "n")


def _finding(covered: Column, beyond: Column) -> Column:
    """A finding with what only its text can tell: whether its excerpt stands there, whether its lines are beyond it."""
    fields = [F.col(c).cast(_KINDS.get(c, "string")).alias(c) for c in _FIELDS]
    flag = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(F.col("ord").cast("long").alias("ord"), *fields, flag(covered).alias("covered"), flag(beyond).alias("beyond"))


def _checks(excerpt: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(the excerpt stands in the text, its lines are beyond the text's) beside the columns _text and _lines."""
    covered = (F.length("_text") > 0) & (F.coalesce(excerpt, F.lit("")) != "") & F.contains(F.col("_text"), scoring.squash(excerpt))
    return covered, (F.col("_lines") > 0) & ((start > F.col("_lines")) | (end > F.col("_lines")))


def scanned_classes(docs: DataFrame, quick: bool = False, rules: list[Rule] = RULES, codes: list[str] | None = None) -> DataFrame:
    """text_key, completeness, has_text, found: one row for each distinct text of docs(text), with its rule findings.

    The texts are brought together by their hash, copies pre-aggregated where they are; null is a text of its own.
    """
    texts = docs.select(text_key(F.col("text")).alias("text_key"), "text").dropDuplicates(["text_key"])
    known = texts.select(F.col("text_key").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), scoring.squash(F.coalesce("text", F.lit(""))).alias("_text"), scoring.line_count(F.coalesce("text", F.lit(""))).alias("_lines"))
    each = _rule_findings(known, quick, rules, codes, ("_text", "_lines"))
    found = each.groupBy(F.col("doc_id").alias("text_key")).agg(F.collect_list(_finding(*_checks(F.col("excerpt"), F.col("line_start"), F.col("line_end")))).alias("found"))
    return texts.join(found, "text_key", "left").select("text_key", completeness(F.coalesce("text", F.lit(""))).alias("completeness"), F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)).alias("has_text"), "found")


def text_key(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _documents(docs: DataFrame, model: DataFrame | None, codes: list[str] | None) -> DataFrame:
    """doc_id, text_key, doc (struct of what is known of it), said (the model's findings that are kept, checked against the text)."""
    if model is None:  # no text to check against, so none is shuffled
        doc = F.struct("doc_type", "industry", "context", F.lit(None).cast("long").alias("n_model"), F.lit(None).cast("long").alias("dropped"))
        return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), doc.alias("doc"), F.lit(None).cast(_SAID).alias("said"))
    based, kept = scoring.kept_of_model(codes)
    per = model.groupBy("doc_id").agg(F.collect_list(F.when(kept, F.struct("ord", *_FIELDS))).alias("said"), F.count_if(kept).alias("n_model"), F.count_if(~based).alias("dropped"))
    text = F.coalesce("text", F.lit(""))
    # the squashed text is made below the join's exchange, once for each document
    known = docs.select("doc_id", "doc_type", "industry", "context", text_key(F.col("text")).alias("text_key"), scoring.squash(text).alias("_text"), scoring.line_count(text).alias("_lines"))

    def checked(x: Column) -> Column:
        covered, beyond = _checks(x["excerpt"], x["line_start"], x["line_end"])
        fields = [x[c].cast(_KINDS.get(c, "string")).alias(c) for c in _FIELDS]
        return F.struct(x["ord"].cast("long").alias("ord"), *fields, F.coalesce(covered, F.lit(False)).alias("covered"), F.coalesce(beyond, F.lit(False)).alias("beyond"))

    return known.join(per, "doc_id", "left").select("doc_id", "text_key", F.struct("doc_type", "industry", "context", "n_model", "dropped").alias("doc"), F.transform("said", checked).alias("said"))


def _merged() -> Column:
    """What a rule's and a model's finding with one key make, r and m; either may be null."""
    r, m = F.col("r"), F.col("m")
    both = r.isNotNull() & m.isNotNull()
    sure = F.when(both, 0.6 * r["confidence"] + 0.4 * m["confidence"]).otherwise(F.coalesce(r["confidence"], m["confidence"]))
    safeguard = F.greatest(r["safeguard_score"], m["safeguard_score"])
    score = F.when(both, irp(r["impact"], r["likelihood"], safeguard)).otherwise(F.coalesce(r["irp_score"], m["irp_score"]))
    made = {"confidence": sure, "safeguard_score": safeguard, "irp_score": score}
    fields = [made.get(c, F.coalesce(r[c], m[c])).alias(c) for c in [*_FIELDS, "covered", "beyond"]]
    # model findings follow the rules' where they tie
    place = [r.isNull().alias("from_model"), F.coalesce(r["ord"], F.col("m_ord")).alias("ord")]
    return F.struct(*place, *fields, F.when(m.isNull(), F.lit(False)).otherwise(sure < 0.6).alias("needs_review"))


def _ordered(docs: DataFrame, model: DataFrame | None, quick: bool, rules: list[Rule], codes: list[str] | None) -> DataFrame:
    """doc_id, doc, findings: a row per document with its merged findings in the order in which they are shown.

    The only shuffle of findings is that by document.
    """
    both = _documents(docs, None if quick else model, codes).join(scanned_classes(docs, quick, rules, codes), "text_key", "left")
    rows = lambda c, of_model: F.coalesce(F.transform(c, lambda x: F.struct(F.lit(of_model).alias("of_model"), x.alias("f"))), F.array())
    doc = F.struct("doc.*", "completeness", "has_text").alias("doc")
    each = both.select("doc_id", doc, F.explode_outer(F.concat(rows(F.col("found"), False), rows(F.col("said"), True))).alias("x")).repartition("doc_id")
    f, of_model = F.col("x.f"), F.col("x.of_model")
    key = [F.lower(f["category"]).alias("k1"), F.lower(F.substring(F.trim(f["excerpt"]), 1, 120)).alias("k2")]
    # what has no category or no excerpt merges with nothing of the other kind
    apart = F.when(f["category"].isNull() | f["excerpt"].isNull(), of_model).alias("k3")
    ours, theirs = F.when(~of_model, f), F.when(of_model, f)
    merged = each.groupBy("doc_id", *key, apart).agg(
        F.any_value("doc").alias("doc"), F.min_by(ours, ours["ord"]).alias("r"), F.max_by(theirs, theirs["ord"]).alias("m"), F.min(theirs["ord"]).alias("m_ord")
    )
    flat = merged.select("doc_id", "doc", F.when(F.col("r").isNotNull() | F.col("m").isNotNull(), _merged()).alias("f")).select("doc_id", "doc", "f", "f.category", "f.severity", "f.irp_score")
    flat = flat.withColumn("severity", F.when(F.col("f").isNotNull(), scoring.weighted_severity(F.col("doc.doc_type"), F.col("doc.industry"))))
    sort = F.struct(*[k.alias(f"s{i}") for i, k in enumerate(scoring.surfacing_keys(F.col("doc.context")))], F.col("f.from_model").alias("from_model"), F.col("f.ord").alias("ord"))
    item = F.when(F.col("f").isNotNull(), F.struct(sort.alias("sort"), F.col("f").withField("severity", F.col("severity")).alias("f")))
    out = flat.groupBy("doc_id").agg(F.any_value("doc").alias("doc"), F.array_sort(F.collect_list(item)).alias("items"))
    return out.select("doc_id", "doc", F.transform("items", lambda x, i: x["f"].withField("place", i + 1)).alias("findings"))


def merged_findings(docs: DataFrame, model: DataFrame | None = None, quick: bool = False, rules: list[Rule] = RULES, codes: list[str] | None = None) -> DataFrame:
    """doc_id, place and the fields of every merged finding, place by place as they are shown."""
    return _ordered(docs, model, quick, rules, codes).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")


def _sum(findings: Column, value, kind: str = "double") -> Column:
    """Sum over the findings in their order, so that it is the same on every run."""
    return F.aggregate(findings, F.lit(0).cast(kind), lambda a, x: (a + value(x)).cast(kind))


def _validated(findings: Column) -> tuple[Column, Column, Column]:
    """(issues, number of issues, what confidence they leave): see scoring.validation(), here over one document's findings."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    has_text, n = F.col("doc.has_text"), F.size(findings)
    none = lambda x: flag(F.coalesce(x["excerpt"], F.lit("")) == "")
    problems = [  # (is one, its words, flags a hallucination)
        (none, "missing excerpt", True),
        (lambda x: flag((x["line_start"] < 1) | (x["line_end"] < 1) | (x["line_start"] > x["line_end"])), "has invalid line numbers", True),
        (lambda x: x["beyond"], "line numbers out of range", True),
        (lambda x: F.coalesce(F.size(x["jurisdictions"]), F.lit(0)) <= 0, "missing jurisdictions", False),
        (lambda x: F.coalesce(F.size(x["legal_basis"]), F.lit(0)) <= 0, "missing legal basis", False),
        (lambda x: has_text & ~none(x) & ~x["covered"], "excerpt not found in document", True),
    ]
    issues = F.filter(F.flatten(F.transform(findings, lambda x: F.array(*[F.when(c(x), F.format_string(f"finding %d: {w}", x["place"])) for c, w, _ in problems]))), lambda x: x.isNotNull())
    uncited = _sum(findings, lambda x: problems[4][0](x).cast("int"), "int")
    flags = _sum(findings, lambda x: sum((c(x).cast("int") for c, _, h in problems if h), F.lit(0)), "int")
    coverage = _sum(findings, lambda x: x["covered"].cast("int"), "int") / n
    low = has_text & (coverage < 0.7)
    left = _sum(findings, lambda x: x["confidence"].cast("decimal(12,8)"), "decimal(20,8)").cast("double") / n - (0.03 * F.size(issues) + 0.07 * uncited + 0.08 * flags + F.when(low, 0.2 * (0.7 - coverage)).otherwise(0.0))
    told = F.when(low, F.array_append(issues, F.format_string("low coverage of citations (%.2f)", coverage))).otherwise(issues)
    empty = n == 0
    return (
        F.when(empty, F.array(F.lit("no findings"))).otherwise(told), F.when(empty, F.lit(1)).otherwise(F.size(issues) + low.cast("int")).cast("long"),
        F.when(empty, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))),
    )


def analyze(docs: DataFrame, model: DataFrame | None = None, answers: DataFrame | None = None, quick: bool = False, rules: list[Rule] = RULES, codes: list[str] | None = None) -> DataFrame:
    """One row per document of docs(doc_id, text, doc_type, industry, context), with findings, scores, verdict and advice.

    model: findings of a language model, as parse_model_findings() gives them; answers(doc_id, summary, overall_confidence).
    doc_id tells documents apart; rows that repeat it are one document. Equal texts are scanned once. Without findings
    there is null for them and for the domains.
    """
    rows = _ordered(docs, model, quick, rules, codes)
    if answers is not None:
        rows = rows.join(answers.select("doc_id", "summary", "overall_confidence"), "doc_id", "left")
    else:
        rows = rows.withColumns({"summary": F.lit(None).cast("string"), "overall_confidence": F.lit(None).cast("double")})
    f, n = F.col("findings"), F.size("findings")
    issues, n_issues, left = _validated(f)
    value = lambda x: F.coalesce(x["irp_score"], scoring.lookup(catalog.SEVERITY_SCORE, x["severity"], 0.5)).cast("decimal(10,6)")
    risk = F.when(n > 0, F.bround(_sum(f, value, "decimal(20,6)").cast("double") / n * 10, 2)).otherwise(0.0)
    rows = rows.withColumns({"issues": issues, "n_issues": n_issues, "validation": left, "risk_score": risk, "completeness": F.col("doc.completeness")})
    sure = scoring.document_confidence(F.col("validation"), F.lit(None).cast("double") if quick else F.col("overall_confidence"), quick, F.coalesce(F.length("summary") > 0, F.lit(False)), F.col("doc.n_model"), F.col("doc.dropped"))
    rows = rows.withColumn("confidence", sure).withColumn("action_readiness", scoring.action_readiness(F.col("risk_score"), F.col("confidence"), F.col("completeness")))
    domains = sorted(set(catalog.DOMAINS.values()))
    own = lambda d: F.slice(F.transform(F.filter(f, lambda x: scoring.lookup(catalog.DOMAINS, x["category"]) == d), lambda x: x["category"]), 1, 2)
    top = F.map_from_arrays(F.array(*map(F.lit, domains)), F.array(*map(own, domains)))
    any_of = lambda kinds: F.exists(f, lambda x: F.coalesce(x["category"].isin(kinds), F.lit(False)))
    asked = {k: any_of(c) for k, c in ADVICE_FOR.items()}
    lines = advice_lines(asked, F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>"), F.col("doc.context"))
    v = scoring.verdict(F.col("doc.context"), F.col("action_readiness"))
    count = lambda s: F.size(F.filter(f, lambda x: x["severity"] == s)).cast("long").alias(f"n_{s.lower()}")
    shown = "place category severity confidence needs_review excerpt explanation jurisdictions legal_basis line_start line_end impact likelihood safeguard_score irp_score from_model".split()
    return rows.select(
        "doc_id", "doc.doc_type", "doc.industry", "doc.context", F.lit("quick" if quick else "full").alias("mode"), scoring.review_status(F.col("confidence")).alias("status"), (F.col("confidence") < 0.8).alias("review_required"),
        "confidence", "risk_score", scoring.grade(F.col("risk_score")).alias("grade"), "completeness", "action_readiness", v["label"].alias("verdict_label"), v["headline"].alias("verdict_headline"),
        n.cast("long").alias("n_findings"), *map(count, ("Critical", "High", "Medium", "Low")), "n_issues", "issues", F.when(n > 0, F.transform(f, lambda x: F.struct(*[x[c].alias(c) for c in shown]))).alias("findings"),
        F.when(F.exists(f, lambda x: F.coalesce(x["category"].isin(list(catalog.DOMAINS)), F.lit(False))), top).alias("top_by_domain"), F.when(n > 0, lines).otherwise(F.array().cast("array<string>")).alias("action_items"), "summary",
    )


def analyze_batch(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(analyses with name and source_document, cross references) of docs(batch, idx, doc_id, text, name, url, ...)."""
    name = F.coalesce("name", "url", F.concat(F.lit("Document "), F.col("idx") + 1))
    done = analyze(docs, **options).join(docs.select("doc_id", "batch", "idx", name.alias("name")), "doc_id")
    done = done.withColumn("findings", F.transform("findings", lambda f: f.withField("source_document", F.col("name"))))
    return done, cross_references(docs)


def cross_references(docs: DataFrame) -> DataFrame:
    """batch, doc_id, target, way, n, reference: one row per reference of a document and later document of its batch.

    docs(batch, idx, doc_id, text). References are found once per document; documents without any send nothing to the
    join, which is on the batch.
    """
    found = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(java(p)), F.lit(0)), lambda x, i: F.struct(F.lit(k).alias("way"), i.alias("n"), x.alias("reference"))) for k, p in enumerate(catalog.REFERENCES)])  # noqa: B023
    refs = docs.select("batch", "idx", "doc_id", F.explode(found).alias("r")).select("batch", "idx", "doc_id", "r.*")
    later = docs.select("batch", F.col("idx").alias("later"), F.col("doc_id").alias("target"))
    return refs.join(later, "batch").filter("idx < later").select("batch", "doc_id", "target", "way", "n", "reference")


def stored(analyses: DataFrame, docs: DataFrame, keep: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(analyses with at most `keep` characters of their text and the result as JSON, reviews that are pending for them); write both with append.

    The analyses are written once, as both tables come from them.
    """
    analyses = written(analyses, "analyses")
    text = docs.select("doc_id", F.substring("text", 1, keep).alias("document_text"), line_offsets(F.substring("text", 1, keep)).alias("line_offsets"))
    rows = analyses.join(text, "doc_id", "left").withColumn("result_json", F.to_json(F.struct(*analyses.columns)))
    return rows, analyses.filter("review_required").select(F.col("doc_id").alias("analysis_id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("notes"))
