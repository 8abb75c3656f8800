"""Rules are looked for in folded text: what that relies on, for every character, and the same matches at the same places."""

import random
from functools import reduce

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from termlake.functions import catalog
from termlake.operators import analysis, rules, scoring

WIDE = catalog.wide_rules()


def test_folding_keeps_every_character_in_its_place_and_kind(spark):
    each = spark.range(0x110000).filter("(id < 55296 or id > 57343) and id <> 65279").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    each = each.select("c", rules.folded(F.col("c")).alias("low"), rules.folded(F.concat(F.lit("aA"), "c", F.lit("Z"))).alias("within"))
    each = each.cache()
    wrong = [F.length("low") != 1, F.length("within") != 4]
    wrong += [F.col("c").rlike(f"(?iUd){p}") != F.col("low").rlike(f"(?Ud){p}") for p in (r"\w", r"\s", r"\d", ".", "[a-z]", "[^a-z]")]
    wrong.append(F.concat(F.lit("a"), "c").rlike(r"(?iUd)a\b") != F.concat(F.lit("a"), "low").rlike(r"(?Ud)a\b"))
    for x in "abcdefghijklmnopqrstuvwxyz":
        wrong += [F.col("c").rlike(f"(?iUd){x}") != (F.col("low") == x), F.col("c").rlike(f"(?iUd)[{x}_]") != F.col("low").isin(x, "_")]
    for k in range(0, len(wrong), 8):
        assert each.filter(reduce(Column.__or__, wrong[k : k + 8])).select(F.hex("c")).take(5) == []
    each.unpersist()


@pytest.mark.parametrize("pattern,form", [
    (r"\bHIPAA\b", r"hipaa(?<=\bhipaa)\b"), (r"\bcookies?\b", r"cookie(?<=\bcookie)s?\b"), (r"\bfee\b.{0,30}\b(copy|request)\b", r"fee(?<=\bfee)\b.{0,30}\b(copy|request)\b"), (r"\Bx\W\S", r"\Bx\W\S"), (r"a|\bB", r"a|\bb"),
    (r"(?-i)Sell", None), (r"(a)\1", None), (r"[A-z]", None), (r"\p{Lu}", None), ("É", None), (r"\x41", None),
])
def test_folded_form(pattern, form):
    assert catalog.folded_form(pattern) == form


def test_same_matches_at_the_same_places(spark):
    rng = random.Random(11)
    odd = "ſell İ ı K 日本 été 𝒳𝒴 Σ ΟΔΟΣ x́ ͅ résell presell".split()
    clauses = [r.example for r in WIDE] + list(catalog.CLAUSES)
    texts = [None, "", "sell data", "presell data, ſELL 𝒳 dATa", "under 13under 13 under 13"]
    for _ in range(150):
        said = [f(rng.choice(clauses)) for f in rng.choices([str, str.upper, str.title, lambda t: t.replace("s", "ſ").replace("k", "K").replace("i", "ı")], k=3)]
        texts.append(rng.choice([" ", "\n", "x", ""]).join(rng.sample(odd + said, k=12)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [*WIDE[:20], *catalog.RULES, catalog.Rule("plain", "Plain", "High", (), (), (r"(?-i)Sell", r"(?:é|日)t?"))]
    spots, seen = [], {}
    for k, r in enumerate(own):
        for j, p in enumerate(r.patterns):
            spots.append(F.struct(F.lit(k).alias("ord"), F.lit(j).alias("j"), F.size(F.regexp_extract_all("text", F.lit(rules.java(p)), F.lit(0))).alias("n"), F.length(F.split("text", rules.java(p), 2)[0]).alias("start"), F.length(F.regexp_substr("text", F.lit(rules.java(p)))).alias("size")))
    for i, k, j, n, start, size in docs.select("doc_id", F.explode(F.array(*spots)).alias("s")).select("doc_id", "s.*").filter("n > 0").collect():
        hits, matches, s, e = seen.get((i, k), (0, 0, start, start + size))
        seen[i, k] = (hits + 1, matches + n, s, e)
    found = {(r["doc_id"], r["ord"]): (r["hits"], r["matches"], r["start"], r["end"]) for r in rules.match_stats(docs, own).collect()}
    assert found == seen and len(found) > 300


def test_sections(spark):
    texts = ["", "Retaın nothing", "pre-opt out", "ſecurit", "a@b", "@b", "Children", "childre", "your RIGHT  to\naccess", "as long as necessary", "has long as necessary", "partners", "third\nparty, profile"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.bround(sum(F.col("text").rlike(rules.java(p)).cast("int") for p in catalog.SECTIONS.values()) / len(catalog.SECTIONS), 2)
    assert docs.filter(rules.completeness(F.col("text")) != plain).count() == 0


def test_a_pattern_is_looked_for_without_case(spark):
    """The plan has no search that ignores case, at each place, for the built-in catalogue."""
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = rules.match_stats(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?iUd" not in plan and "(?Ud)sell" in plan


def test_squash_and_lines(spark):
    rng = random.Random(1)
    marks = ["a", " ", "  ", "\n", "\r", "\r\n", "\t", "\xa0", "\x85", "\u2028", "\x0b", "\x1c", "B", "\u3000", "𝒳"]
    docs = spark.createDataFrame([("".join(rng.choices(marks, k=rng.randint(0, 14))),) for _ in range(5000)], "text string")
    plain = F.lower(F.regexp_replace(F.regexp_replace("text", r"(?U)\s+", " "), "^ | $", ""))
    lines = F.when(F.length("text") > 0, F.size(F.split(F.regexp_replace("text", f"({scoring._BREAKS})$", ""), scoring._BREAKS, -1))).otherwise(0)
    assert docs.filter((scoring.squash(F.col("text")) != plain) | (scoring.line_count(F.col("text")) != lines)).count() == 0


def test_quick_analysis_shuffles_no_text_for_a_model(spark):
    docs = spark.createDataFrame([(1, "We sell your data.", "Combined", "General", ["for_child"])], "doc_id long, text string, doc_type string, industry string, context array<string>")
    shuffled = lambda model: "_text" in analysis._documents(docs, model, None)._jdf.queryExecution().optimizedPlan().toString()
    model = spark.createDataFrame([], "doc_id long, ord int, category string, severity string, confidence double, excerpt string, explanation string, jurisdictions array<string>, legal_basis array<string>, line_start int, line_end int, impact int, likelihood int, safeguard_score int, irp_score double")
    assert shuffled(model) and not shuffled(None)
