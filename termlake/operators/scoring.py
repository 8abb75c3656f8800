"""Model findings, merging, scores, confidence, verdicts and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog
from .rules import irp


def lookup(table: dict, key: Column, default=None) -> Column:
    """A small fixed table as a CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def grade(score: Column) -> Column:
    out = F.when(score >= catalog.GRADES[0][0], catalog.GRADES[0][1])
    for bound, name in catalog.GRADES[1:]:
        out = out.when(score >= bound, name)
    return out.otherwise("A")


def mean_value() -> Column:
    """Mean of the findings' scores; the sum is of decimals, so that it doesn't depend on the order of rows."""
    value = F.coalesce("irp_score", lookup(catalog.SEVERITY_SCORE, F.col("severity"), 0.5))
    return F.sum(value.cast("decimal(10,6)")).cast("double") / F.count(value)


def risk_scores(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, risk_score (0 to 10, 0 without findings), grade."""
    mean = findings.groupBy("doc_id").agg(mean_value().alias("mean"))
    score = F.coalesce(F.bround(F.col("mean") * 10, 2), F.lit(0.0))
    return docs.select("doc_id").join(mean, "doc_id", "left").select("doc_id", score.alias("risk_score"), grade(score).alias("grade"))


def action_readiness(risk: Column, confidence: Column, completeness: Column) -> Column:
    return F.when((risk >= 7) | (completeness < 0.375), "Stop").when((risk < 4) & (confidence >= 0.65) & (completeness >= 0.625), "Go").otherwise("Review")


def review_status(confidence: Column, threshold: float = 0.8) -> Column:
    """needs_review below the threshold."""
    return F.when(confidence < threshold, "needs_review").otherwise("completed")


def resolve_context(contexts: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(contexts, c), F.lit(c)) for c in catalog.CONTEXT_PRIORITY], F.lit("want_understand"))


def verdict(contexts: Column, readiness: Column, wording: dict = catalog.VERDICTS) -> Column:
    """Struct (label, headline) for the strongest context; an unknown readiness reads as Review."""
    chip, out = resolve_context(contexts), None
    for c, by_readiness in wording.items():
        pair = {r: F.struct(F.lit(w[0]).alias("label"), F.lit(w[1]).alias("headline")) for r, w in by_readiness.items()}
        own = F.when(readiness == "Go", pair["Go"]).when(readiness == "Stop", pair["Stop"]).otherwise(pair["Review"])
        out = F.when(chip == c, own) if out is None else out.when(chip == c, own)
    return out


def bump_severity(severity: Column, category: Column, group: Column, boosts: dict) -> Column:
    """One level up where the group boosts the category by 0.2 or more."""
    known = F.array_position(F.array(*map(F.lit, catalog.SEVERITIES)), severity)
    level = F.when(known == 0, F.raise_error(F.concat(F.lit("unknown severity "), severity)).cast("bigint")).otherwise(known)
    up = F.lit(False)
    for g, table in boosts.items():
        names = [c for c, b in table.items() if b >= 0.2]
        up = up | ((group == g) & category.isin(names))
    return F.element_at(F.array(*map(F.lit, catalog.SEVERITIES)), F.least(F.lit(4), level + F.coalesce(up, F.lit(False)).cast("int")).cast("int"))


def weighted_severity(doc_type: Column, industry: Column) -> Column:
    """The severity after the boosts of the document's type, then of its industry."""
    once = bump_severity(F.col("severity"), F.col("category"), doc_type, catalog.DOC_TYPE_BOOSTS)
    return bump_severity(once, F.col("category"), industry, catalog.INDUSTRY_BOOSTS)


def context_weight(category: Column, contexts: Column) -> Column:
    """Sum over the contexts (a repeated one counts twice), at most 3; 1 where none weighs the category."""
    total = F.aggregate(
        F.coalesce(contexts, F.array().cast("array<string>")), F.lit(0.0),
        lambda acc, c: acc + sum((F.when(c == name, lookup(table, category, 0.0)).otherwise(0.0) for name, table in catalog.WEIGHTS.items() if table), F.lit(0.0)),
    )
    return F.when(total > 0, F.least(total, F.lit(3.0))).otherwise(1.0)


def surfacing_keys(contexts: Column) -> list[Column]:
    """What findings are shown by, ascending: weight, impact and severity, the highest first."""
    impact = F.coalesce("irp_score", lookup(catalog.SEVERITY_FALLBACK, F.col("severity"), 0.5))
    rank = lookup({s: k for k, s in enumerate(catalog.SEVERITIES, 1)}, F.col("severity"), 0)
    return [-context_weight(F.col("category"), contexts), -impact, -rank]


def surfacing_order(findings: DataFrame, contexts: str = "context") -> DataFrame:
    """Adds place: by weight, impact and severity, ties in catalogue order."""
    w = Window.partitionBy("doc_id").orderBy(*surfacing_keys(F.col(contexts)), "ord")
    return findings.withColumn("place", F.row_number().over(w))


def top_by_domain(ordered: DataFrame, per_domain: int = 2) -> DataFrame:
    domain = lookup(catalog.DOMAINS, F.col("category"))
    w = Window.partitionBy("doc_id", "domain").orderBy("place")
    return ordered.withColumn("domain", domain).filter("domain is not null").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_domain)


def top_risks(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k highest scores of each document, ties by name."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("irp"), "category")
    return scores.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)


def _kind(item: Column, path: str) -> Column:
    """The JSON type at a path as VARIANT names it; null where there is nothing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(item, path, "variant"))


def _number(item: Column, path: str, least: float, most: float | None, default: float | None = None, whole: bool = True, optional: bool = False) -> tuple[Column, Column]:
    """(value, whether it is one): a JSON number, numeric string or boolean in its range, without a fraction if whole.

    Nothing at the path gives the default, or is wrong if there is none; a JSON null is wrong unless optional.
    """
    x, kind = F.try_variant_get(item, path, "double"), _kind(item, path)
    right = (x >= least) & (F.lit(True) if most is None else x <= most) & (x == F.floor(x) if whole else F.lit(True)) & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")
    missing = kind.isNull() | (kind == "VOID") if optional else kind.isNull()
    return F.when(missing, F.lit(default).cast("double")).otherwise(x), F.when(missing, F.lit(default is not None or optional)).otherwise(F.coalesce(right, F.lit(False)))


def _text(item: Column, path: str) -> tuple[Column, Column]:
    return F.try_variant_get(item, path, "string"), F.coalesce(_kind(item, path) == "STRING", F.lit(False))


def _texts(item: Column, path: str, allowed: list[str] | None = None, optional: bool = False) -> tuple[Column, Column]:
    """(array of strings, whether it is one and every string is allowed)."""
    each, kind = F.try_variant_get(item, path, "array<variant>"), _kind(item, path)
    values = F.transform(each, lambda x: F.try_variant_get(x, "$", "string"))
    right = F.forall(each, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    if allowed:
        right = right & F.forall(values, lambda x: x.isin(allowed))
    fine = F.coalesce(right, F.lit(False))
    return (F.coalesce(values, F.array().cast("array<string>")), kind.isNull() | fine) if optional else (values, fine)


def parse_model_findings(answers: DataFrame, jurisdictions: list[str] | None = catalog.JURISDICTIONS) -> DataFrame:
    """Findings of answers(doc_id, body): body is JSON with a list `findings`.

    Every item is checked by itself and only what is wrong is skipped: an item that isn't an object, a field that is
    missing or of another type, an unknown severity or jurisdiction (None: any is fine), a number out of its range or
    with a fraction where there can't be one. Numbers may be numeric strings or booleans. Impact, likelihood and safeguard
    default to 2, 3 and 0, and without a score give it. Of duplicate keys the last counts (a setting of the session's JSON
    reader, set here). A body that isn't JSON, no object, or has no list of findings has no rows. `ord` is the place in the list.
    """
    answers.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    items = F.try_variant_get(F.try_parse_json("body"), "$.findings", "array<variant>")
    f = F.col("f")
    each = answers.select("doc_id", F.posexplode(items).alias("ord", "f"))
    texts = {c: _text(f, f"$.{c}") for c in ("category", "severity", "excerpt", "explanation")}
    numbers = {
        "confidence": _number(f, "$.confidence", 0, 1, whole=False), "line_start": _number(f, "$.evidence.line_start", 1, None), "line_end": _number(f, "$.evidence.line_end", 1, None),
        "impact": _number(f, "$.impact", 1, 5, 2), "likelihood": _number(f, "$.likelihood", 1, 5, 3), "safeguard_score": _number(f, "$.safeguard_score", 0, 5, 0),
        "irp_score": _number(f, "$.irp_score", 0, 1, whole=False, optional=True),
    }
    lists = {"jurisdictions": _texts(f, "$.jurisdictions", jurisdictions), "legal_basis": _texts(f, "$.evidence.legal_basis", optional=True)}
    told = F.try_variant_get(f, "$.needs_review", "boolean")
    fields = {**texts, **numbers, **lists}
    fine = F.coalesce(F.schema_of_variant(f).startswith("OBJECT"), F.lit(False)) & texts["severity"][0].isin(catalog.SEVERITIES) & (_kind(f, "$.needs_review").isNull() | told.isNotNull())
    for _, right in fields.values():
        fine = fine & right
    j = each.filter(fine).select("doc_id", "ord", *[v.alias(c) for c, (v, _) in fields.items()], F.coalesce(told, F.lit(False)).alias("told"))
    whole = {c: F.col(c).cast("int") for c in ("line_start", "line_end", "impact", "likelihood", "safeguard_score")}
    return j.select(
        "doc_id", "ord", "category", "severity", "confidence", "excerpt", "explanation", "jurisdictions", "legal_basis", *[v.alias(c) for c, v in list(whole.items())[:2]],
        (F.col("told") | (F.col("confidence") < 0.6)).alias("needs_review"), *[v.alias(c) for c, v in list(whole.items())[2:]],
        F.coalesce("irp_score", irp(whole["impact"], whole["likelihood"], whole["safeguard_score"])).alias("irp_score"),
    )


def model_finding_filter(model: DataFrame, codes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept findings, (doc_id, dropped)): what has no legal basis goes and counts, what has no jurisdiction or none of `codes` goes."""
    based, kept = kept_of_model(codes)
    return model.filter(kept), model.filter(~based).groupBy("doc_id").agg(F.count("*").alias("dropped"))


def kept_of_model(codes: list[str] | None = None) -> tuple[Column, Column]:
    """(whether a model finding has a legal basis, whether it is kept)."""
    based = F.coalesce(F.size("legal_basis"), F.lit(0)) > 0
    claims = F.coalesce(F.size("jurisdictions"), F.lit(0)) > 0
    wanted = F.arrays_overlap("jurisdictions", F.array(*map(F.lit, codes))) if codes else F.lit(True)
    return based, based & claims & wanted


def merge_findings(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Rule and model findings of a document by category and the excerpt's first 120 characters.

    Of rule findings with one key the first stays, of model findings the last, at the first one's place. What both
    have keeps the rule's fields with a mixed confidence and the better safeguard. ord counts rules first.
    """
    keys = [F.lower("category").alias("k1"), F.lower(F.substring(F.trim("excerpt"), 1, 120)).alias("k2")]
    key = Window.partitionBy("doc_id", "k1", "k2")
    r = rules.select("*", *keys).withColumn("n", F.row_number().over(key.orderBy("ord"))).filter("n = 1").drop("n").alias("r")
    m = model.select("*", *keys).withColumn("n", F.row_number().over(key.orderBy(F.desc("ord")))).withColumn("ord", F.min("ord").over(key)).filter("n = 1").drop("n").alias("m")
    both = r.join(m, ["doc_id", "k1", "k2"], "full")
    confidence = F.when(F.col("r.confidence").isNull(), F.col("m.confidence")).when(F.col("m.confidence").isNull(), F.col("r.confidence")).otherwise(0.6 * F.col("r.confidence") + 0.4 * F.col("m.confidence"))
    safeguard = F.greatest("r.safeguard_score", "m.safeguard_score")
    matched = F.col("r.ord").isNotNull() & F.col("m.ord").isNotNull()
    score = F.when(matched, irp(F.col("r.impact"), F.col("r.likelihood"), safeguard)).otherwise(F.coalesce("r.irp_score", "m.irp_score"))
    review = F.when(F.col("m.ord").isNull(), F.lit(False)).otherwise(confidence < 0.6)
    made = ("doc_id", "confidence", "needs_review", "irp_score", "ord", "safeguard_score")
    either = [F.coalesce(f"r.{c}", f"m.{c}").alias(c) for c in rules.columns if c in model.columns and c not in made]
    return both.select(
        "doc_id", *either, confidence.alias("confidence"), review.alias("needs_review"), safeguard.alias("safeguard_score"), score.alias("irp_score"),
        F.col("r.ord").isNull().alias("from_model"), F.coalesce("r.ord", "m.ord").alias("ord"),
    )


def squash(c) -> Column:
    """Lower case, white space as one space, none at the ends; single spaces, which most are, are left where they stand."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U) \s+|[^\S ]\s*", " ")))


_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def line_count(text: Column) -> Column:
    """Lines of a text, ended by any of the usual line ends; a last empty line doesn't count."""
    at = F.greatest(F.length(text) - 8, F.lit(0))  # what ends a text stands in its last four characters
    whole = F.concat(F.substring(text, F.lit(1), at), F.regexp_replace(F.substring(text, at + 1, F.lit(8)), f"({_BREAKS})$", ""))
    return F.when(F.length(text) > 0, F.size(F.split(whole, _BREAKS, -1))).otherwise(0)


def validation(findings: DataFrame, docs: DataFrame, place: str = "ord") -> DataFrame:
    """doc_id, n_issues, issues, validation for every document: what confidence its findings leave after penalties.

    findings(doc_id, excerpt, line_start, line_end, jurisdictions, legal_basis, confidence, place); docs(doc_id, text).
    Issues name the finding's number in the order of `place`. A document without findings has confidence 0 and one issue.
    """
    numbered = findings.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy(place)))
    text = docs.select("doc_id", squash("text").alias("_text"), line_count(F.col("text")).alias("_lines"))
    f = numbered.join(text, "doc_id")
    flag = lambda c: F.coalesce(c, F.lit(False))
    none = flag(F.coalesce("excerpt", F.lit("")) == "")
    has_text = flag(F.length("_text") > 0)
    covered = has_text & ~none & flag(F.contains("_text", squash("excerpt")))
    problems = [  # (is one, its words, flags a hallucination)
        (none, "missing excerpt", True),
        (flag((F.col("line_start") < 1) | (F.col("line_end") < 1) | (F.col("line_start") > F.col("line_end"))), "has invalid line numbers", True),
        (flag((F.col("_lines") > 0) & ((F.col("line_start") > F.col("_lines")) | (F.col("line_end") > F.col("_lines")))), "line numbers out of range", True),
        (F.coalesce(F.size("jurisdictions"), F.lit(0)) <= 0, "missing jurisdictions", False),
        (F.coalesce(F.size("legal_basis"), F.lit(0)) <= 0, "missing legal basis", False),
        (has_text & ~none & ~covered, "excerpt not found in document", True),
    ]
    issues = F.filter(F.array(*[F.when(c, F.format_string(f"finding %d: {w}", "number")) for c, w, _ in problems]), lambda x: x.isNotNull())
    checked = f.select("doc_id", "number", "confidence", issues.alias("issues"), problems[4][0].cast("int").alias("uncited"), sum((c.cast("int") for c, _, h in problems if h), F.lit(0)).alias("flags"), covered.cast("int").alias("covered"), has_text.alias("has_text"))
    s = checked.groupBy("doc_id").agg(
        F.avg("confidence").alias("mean"), F.sum(F.size("issues")).alias("n"), F.sum("uncited").alias("uncited"), F.sum("flags").alias("flags"), F.avg("covered").alias("coverage"), F.any_value("has_text").alias("has_text"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "issues"))), lambda x: x["issues"])).alias("issues"),
    )
    low = F.col("has_text") & (F.col("coverage") < 0.7)
    left = F.col("mean") - (0.03 * F.col("n") + 0.07 * F.col("uncited") + 0.08 * F.col("flags") + F.when(low, 0.2 * (0.7 - F.col("coverage"))).otherwise(0.0))
    s = s.select("doc_id", (F.col("n") + low.cast("int")).alias("n_issues"), F.when(low, F.array_append("issues", F.format_string("low coverage of citations (%.2f)", "coverage"))).otherwise(F.col("issues")).alias("issues"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("validation"))
    return docs.select("doc_id").join(s, "doc_id", "left").select(
        "doc_id", F.coalesce("n_issues", F.lit(1)).cast("long").alias("n_issues"), F.coalesce("issues", F.array(F.lit("no findings"))).alias("issues"), F.coalesce("validation", F.lit(0.0)).alias("validation")
    )


def document_confidence(validation: Column, overall: Column, quick: bool, has_summary: Column, n_model: Column, dropped: Column) -> Column:
    """Mean of what validation left and of the model's own confidence (if any), less for a quick scan, a missing summary or model, and dropped findings."""
    mean = F.when(overall.isNull(), validation).otherwise((validation + F.greatest(F.lit(0.0), F.least(F.lit(1.0), overall))) / 2)
    if quick:
        less = mean * 0.85
    else:
        less = mean * F.when(~F.coalesce(has_summary, F.lit(False)), 0.8).when(F.coalesce(n_model, F.lit(0)) == 0, 0.85).otherwise(1.0)
        less = less * F.when(F.coalesce(dropped, F.lit(0)) > 0, F.greatest(F.lit(0.5), 1 - 0.1 * dropped)).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), less))
