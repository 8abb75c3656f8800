"""The rule scan: findings with evidence, confidence and seeded impact.

A text is scanned once. With few patterns each counts its matches where the text holds the pattern's
anchor, a piece of plain text that all its matches have, which is some ten times cheaper to look for.
With more, the distinct words of a text are held against an inverted table of the patterns' anchor
words, and only candidate patterns are counted, so the cost hardly grows with the catalogue. The
counts of a rule are an array, so that a rule's hits, matches and first pattern
come from it. Where a match stands is looked up for the rules that hit, and not at all by rule_hits().
Columns named in `carry` come along, so that nothing is joined back to the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.catalog import RULES, Rule


def spread(docs: DataFrame) -> DataFrame:
    """Dealt over all cores where there are fewer files than cores: one row group is one task, and a scan is long work."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(n) if len(docs.inputFiles()) < n else docs


def java(pattern: str, fold: bool = True, lines: bool = False) -> str:
    """The pattern with Unicode classes and newline as the only line end, as Java spells them."""
    return f"(?{'i' if fold else ''}Ud{'m' if lines else ''}){pattern}"


def folded(text: Column) -> Column:
    """Lower case, with the four letters that count as ASCII letters when case is ignored; every character stays one, at its place."""
    # the Kelvin sign is lower()'s; the last two are capitals to lower() only, and no letters to Java's patterns
    odd, plain = "\u017f\u0131\u0130\ua7cb\ua7dc", "sii\x01\x01"
    # translate() looks every character up: only where there is one of these
    held = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in odd])
    return F.lower(F.when(held, F.translate(text, odd, plain)).otherwise(text))


def _scanned(pattern: str, lines: bool = False) -> tuple[str, bool]:
    """(the pattern as it is looked for, whether in _low rather than in text): a pattern that may fold needs no test of case at each place."""
    low = catalog.folded_form(pattern)
    return (f"(?Ud{'m' if lines else ''}){low}", True) if low is not None else (java(pattern, lines=lines), False)


def applicable(rules: list[Rule], codes: list[str] | None) -> list[Rule]:
    """Rules that share a jurisdiction with the codes; no codes, no filter. Pruned before planning."""
    return [r for r in rules if not codes or set(r.jurisdictions) & set(codes)]


def irp(impact: Column, likelihood: Column, safeguard: Column) -> Column:
    raw = 0.5 * (impact / 5) + 0.4 * (likelihood / 5) - 0.3 * (safeguard / 5)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.bround(raw, 4)))


def _count(pattern: str, lines: bool) -> Column:
    p, on_low = _scanned(pattern, lines)
    n = F.regexp_count("_low" if on_low else "text", F.lit(p))
    a = catalog.anchor(pattern)
    return F.coalesce(F.when(F.col("_low").contains(a), n).otherwise(0) if a else n, F.lit(0))


def _counts(rule: Rule, lines: bool) -> Column:
    return F.array(*[_count(p, lines) for p in rule.patterns])


#: From so many patterns on, candidates are found by words.
MANY = 100


def _literal_hits(rules: list[Rule], codes: list[str] | None, lines: bool) -> Column:
    """Structs (ord, counts) of the rules that match, each pattern a literal behind its anchor."""
    chosen = applicable(rules, codes)
    found = [F.struct(F.lit(k).alias("ord"), _counts(r, lines).alias("counts")) for k, r in enumerate(rules) if r in chosen and r.patterns]
    if not found:
        found = [F.lit(None).cast("struct<ord:int,counts:array<int>>")]
    return F.filter(F.array(*found), lambda r: F.exists(r["counts"], lambda n: n > 0))


def _candidate_hits(rules: list[Rule], codes: list[str] | None, lines: bool) -> Column:
    """The same from candidates: patterns of which an anchor word is among the text's words, and those that have none.

    All within the row: no word is shuffled, and the tables are literals as large as the catalogue.
    """
    chosen = applicable(rules, codes)
    numbered = [(k, j, p) for k, r in enumerate(rules) if r in chosen for j, p in enumerate(r.patterns)]
    by_word: dict[str, list[int]] = {}
    always = []  # patterns without an anchor word are literals, and compiled once
    for i, (k, j, p) in enumerate(numbered):
        anchors = catalog.anchor_words(p)
        for w in anchors or ():
            by_word.setdefault(w, []).append(i)
        if not anchors:
            always.append(F.struct(F.lit(k).alias("ord"), F.lit(j).alias("j"), _count(p, lines).alias("n")))
    ints = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    known = sorted(by_word)
    lists = F.array(*[ints(by_word[w]) for w in known]) if known else F.array(ints([]))
    tokens = F.array_distinct(F.regexp_extract_all("_low", F.lit(r"(?U)\w+"), F.lit(0)))
    hit_words = F.array_intersect(tokens, F.array(*map(F.lit, known)).cast("array<string>"))
    candidates = F.array_distinct(F.flatten(F.transform(hit_words, lambda w: F.element_at(lists, F.array_position(F.array(*map(F.lit, known)).cast("array<string>"), w).cast("int")))))
    scanned = [_scanned(p, lines) for _, _, p in numbered]
    patterns, on_low = F.array(*[F.lit(p) for p, _ in scanned]), F.array(*[F.lit(low) for _, low in scanned])
    counted = F.transform(candidates, lambda i: F.struct(F.element_at(F.array(*[F.lit(k) for k, _, _ in numbered]), i + 1).alias("ord"), F.element_at(F.array(*[F.lit(j) for _, j, _ in numbered]), i + 1).alias("j"), F.regexp_count(F.when(F.element_at(on_low, i + 1), F.col("_low")).otherwise(F.col("text")), F.element_at(patterns, i + 1)).alias("n")))
    hits = F.filter(F.concat(counted, F.array(*always)) if always else counted, lambda c: c["n"] > 0)
    sizes = ints([len(r.patterns) for r in rules])

    def counts(hits: Column, k: Column) -> Column:
        places = F.sequence(F.lit(0), F.element_at(sizes, k + 1) - 1)
        own = F.filter(hits, lambda h: h["ord"] == k)
        return F.transform(places, lambda j: F.aggregate(own, F.lit(0), lambda a, h: a + F.when(h["j"] == j, h["n"]).otherwise(0)))

    # the hits of a text are few; they are bound once and grouped by rule, in the catalogue's order
    return F.flatten(F.transform(F.array(hits), lambda hs: F.transform(F.array_sort(F.array_distinct(F.transform(hs, lambda h: h["ord"]))), lambda k: F.struct(k.alias("ord"), counts(hs, k).alias("counts")))))


def _scan(docs: DataFrame, rules: list[Rule], codes: list[str] | None, carry: tuple, lines: bool = False, way: str | None = None) -> DataFrame:
    """doc_id, text, _low (the text folded), ord, counts (of each pattern) and the carried columns, for each rule that matches; way: literal or candidates, by default by the number of patterns."""
    n = sum(len(r.patterns) for r in applicable(rules, codes))
    if n and (way == "candidates" or way is None and n >= MANY):
        hit = _candidate_hits(rules, codes, lines)
    else:
        hit = _literal_hits(rules, codes, lines)
    low = docs.select("doc_id", "text", *carry, folded(F.col("text")).alias("_low"))
    return low.select("doc_id", "text", "_low", *carry, F.explode(hit).alias("m")).select("doc_id", "text", "_low", *carry, "m.ord", "m.counts")


def _stats() -> list[Column]:
    return [
        F.size(F.filter("counts", lambda n: n > 0)).alias("hits"),
        F.aggregate("counts", F.lit(0), lambda a, n: a + n).alias("matches"),
        F.array_position(F.transform("counts", lambda n: n > 0), True).cast("int").alias("pattern"),
    ]


def rule_table(spark, rules: list[Rule] = RULES, lines: bool = False) -> DataFrame:
    """A row per rule; scans has each pattern as it is looked for, and whether in _low."""
    rows = [
        (k, r.category, r.severity, list(r.jurisdictions), list(r.legal_basis), len(r.patterns), *catalog.IRP.get(r.category, catalog.IRP_DEFAULT), [_scanned(p, lines) for p in r.patterns], explanation(r))
        for k, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, "ord int, category string, severity string, jurisdictions array<string>, legal_basis array<string>, n_patterns int, impact int, likelihood int, scans array<struct<pattern:string,on_low:boolean>>, explanation string")


def explanation(rule: Rule) -> str:
    return rule.explanation or f"Wording about {rule.category.lower()} was found."


def rule_hits(docs: DataFrame, rules: list[Rule] = RULES, codes: list[str] | None = None, carry: tuple = (), way: str | None = None) -> DataFrame:
    """doc_id, ord, hits, category, severity, jurisdictions, legal_basis, confidence, irp_score: findings without their places."""
    hit = _scan(docs, rules, codes, carry, way=way).select("doc_id", *carry, "ord", *_stats())
    r = F.broadcast(rule_table(docs.sparkSession, rules).drop("scans", "explanation"))  # a row per rule
    return hit.join(r, "ord").select(
        "doc_id", *carry, "ord", "hits", "matches", "category", "severity", "jurisdictions", "legal_basis",
        confidence(F.col("hits"), F.col("n_patterns")).alias("confidence"), irp(F.col("impact"), F.col("likelihood"), F.lit(0)).alias("irp_score"),
    )


def match_stats(docs: DataFrame, rules: list[Rule] = RULES, codes: list[str] | None = None, carry: tuple = ()) -> DataFrame:
    """doc_id, text, ord, hits, matches, start, end of each rule that matches, and the rule's columns; the first pattern in list order counts."""
    hit = _scan(docs, rules, codes, carry).select("doc_id", "text", "_low", *carry, "ord", *_stats())
    at = hit.join(F.broadcast(rule_table(docs.sparkSession, rules)), "ord").withColumn("p", F.element_at("scans", F.col("pattern")))
    # one cut gives both ends; folding keeps lengths
    at = at.withColumn("looked", F.when(F.col("p.on_low"), F.col("_low")).otherwise(F.col("text")))
    at = at.withColumn("parts", F.split("looked", F.col("p.pattern"), 2)).withColumn("start", F.length(F.get("parts", F.lit(0))))
    end = F.nullif(F.length("looked") - F.length(F.get("parts", F.lit(1))), F.col("start"))
    return at.withColumn("end", end).drop("p", "parts", "looked", "_low", "scans", "pattern")


def confidence(hits: Column, total: Column) -> Column:
    ratio = hits / total
    raw = F.when(hits >= total * 0.5, 0.93 + 0.02 * F.least(F.lit(1.0), ratio)).otherwise(0.90 + 0.03 * ratio)
    return F.greatest(F.lit(0.90), F.least(F.lit(0.95), raw))


def line_number(text: Column, offset: Column) -> Column:
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def excerpt(text: Column, start: Column, end: Column, window: int = 140) -> Column:
    first = F.greatest(F.lit(0), start - window)
    return F.regexp_replace(F.substring(text, first + 1, end + window - first), r"(?U)^\s+|\s+$", "")


def sentence_context(text: Column, n: int = 2, after: bool = False) -> Column:
    """The last (or, for what follows a match, the first) n sentences; the marks between them are lost."""
    parts = F.split(text, r"[.!?](?U:\s)+")
    kept = F.slice(parts, 1, n) if after else F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (n - 1)), F.lit(n))
    return F.regexp_replace(F.array_join(kept, " "), r"(?U)^\s+|\s+$", "")


def detect_findings(docs: DataFrame, rules: list[Rule] = RULES, codes: list[str] | None = None, carry: tuple = ()) -> DataFrame:
    """One row per document and matching rule, in catalogue order (`ord`), with evidence. The rule table has a row per rule: broadcast."""
    text = F.col("text")
    return match_stats(docs, rules, codes, carry).select(
        "doc_id", *carry, "ord", "category", "severity", "jurisdictions", "legal_basis", "explanation",
        confidence(F.col("hits"), F.col("n_patterns")).alias("confidence"),
        excerpt(text, F.col("start"), F.col("end")).alias("excerpt"),
        F.col("start").alias("start_offset"), F.col("end").alias("end_offset"),
        line_number(text, F.col("start")).alias("line_start"), line_number(text, F.col("end")).alias("line_end"),
        sentence_context(F.substring(text, F.lit(1), F.col("start"))).alias("context_before"),
        sentence_context(F.substring(text, F.col("end") + 1, F.length(text)), after=True).alias("context_after"),
        F.lit(False).alias("needs_review"), "impact", "likelihood", F.lit(0).alias("safeguard_score"),
        irp(F.col("impact"), F.col("likelihood"), F.lit(0)).alias("irp_score"),
    )


def detect_quick(docs: DataFrame, rules: list[Rule] = RULES, codes: list[str] | None = None, carry: tuple = ()) -> DataFrame:
    """Every match of every pattern of severe rules, with 50 characters around it; ord is the rule, pattern and n say which match.

    The texts between matches and the matches themselves give the offsets: a running sum over the array's places.
    """
    severe = [r if r.severity in ("High", "Critical") else Rule(r.name, r.category, r.severity, (), r.legal_basis, ()) for r in rules]
    each = _scan(docs, severe, codes, carry, True)
    each = each.select("doc_id", "text", "_low", *carry, "ord", F.posexplode("counts").alias("pattern", "count")).filter("count > 0")
    at = each.join(F.broadcast(rule_table(docs.sparkSession, rules, True)), "ord").withColumn("p", F.element_at("scans", F.col("pattern") + 1))
    at = at.withColumn("looked", F.when(F.col("p.on_low"), F.col("_low")).otherwise(F.col("text")))
    # columns of their own, so that each is made once
    at = at.withColumn("hits", F.regexp_extract_all("looked", F.col("p.pattern"), F.lit(0))).withColumn("pieces", F.split("looked", F.col("p.pattern"), -1))
    pieces, hits = F.col("pieces"), F.col("hits")
    sizes = F.zip_with(hits, F.slice(pieces, 1, F.size(hits)), lambda h, b: F.struct(F.length(b).alias("gap"), F.length(h).alias("size")))
    spans = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"))).alias("out")),
    )["out"]
    rows = at.withColumn("spans", spans).select("*", F.posexplode("spans").alias("n", "s")).drop("spans")
    start, end, text = F.col("s.start"), F.col("s.end"), F.col("text")
    return rows.select(
        "doc_id", *carry, "ord", "pattern", "n", "category", "severity", "jurisdictions", "legal_basis", "explanation", F.lit(0.8).alias("confidence"), excerpt(text, start, end, 50).alias("excerpt"),
        line_number(text, start).alias("line_start"), line_number(text, end).alias("line_end"), F.lit(False).alias("needs_review"),
        "impact", "likelihood", F.lit(0).alias("safeguard_score"), irp(F.col("impact"), F.col("likelihood"), F.lit(0)).alias("irp_score"),
    )


def completeness(text: Column, sections: dict[str, str] = catalog.SECTIONS) -> Column:
    """Share of the expected sections that a text has; each alternative is looked for behind its anchor."""

    def has(p: str, low: Column) -> Column:
        each = []
        for x in catalog.alternatives(p):
            f, a = catalog.folded_form(x), catalog.anchor(x)
            hit = text.rlike(java(x)) if f is None else low.rlike(f"(?Ud){f}")
            each.append(low.contains(a) & hit if a else hit)
        return F.coalesce(reduce(Column.__or__, each), F.lit(False)).cast("int")

    # folded once for all sections
    n = F.transform(F.array(folded(text)), lambda low: sum((has(p, low) for p in sections.values()), F.lit(0)))[0]
    return F.bround(n / len(sections), 2)
