"""Quality rules as weak supervision, in DataFrame operations only.

Rules look at a document's statistics and vote good (1), bad (-1) or abstain (0). Votes are
counted per distinct pattern (at most 3 ** rules rows, whatever the corpus), and
expectation-maximisation on that table estimates, for each rule and class, how often it votes good
or bad. A document's posterior probability of being good, in which an abstaining rule has no say,
then decides, instead of having to pass every rule.

Words are runs of anything but ASCII white space. A word stands in a repeated window if a window
of `width` words that covers it occurs at least twice in the text. Windows are compared by 64-bit
hash, within the document's row.

Defined cases: null or blank text has no words, every count is 0 and it fails the base rule;
repeated rows are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def statistics(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, text_key and the counts for every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    split = base.select(
        "doc_id", F.xxhash64("text").alias("text_key"),
        F.array_remove(F.split("text", SPACE + "+", -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "").alias("lines"),
        # one pass over the text; the counts below look at what is left
        F.array_join(F.regexp_extract_all("text", F.lit(f"[A-Z0-9!?{SYMBOLS}]+"), F.lit(0)), "").alias("marks"),
    )
    of_marks = lambda kind: (F.size(F.split("marks", f"[{kind}]", -1)) - 1).cast("long")
    # a window is the struct of its words; only whole windows
    whole = F.greatest(F.size("words") - (width - 1), F.lit(0))
    windows = F.arrays_zip(*[F.slice("words", k + 1, whole).alias(f"w{k}") for k in range(width)])
    counted = split.select(
        "doc_id", "text_key",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        of_marks(SYMBOLS).alias("n_symbols"), of_marks("A-Z").alias("n_upper"), of_marks("0-9").alias("n_digits"), of_marks("!?").alias("n_shouts"),
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(windows, lambda w: F.xxhash64(w)).alias("grams"),
    )
    return repeated_words(counted, width)


def repeated_words(counted: DataFrame, width: int = 5) -> DataFrame:
    """n_repeat_words in place of grams, the hashes of a text's windows in text order. The windows of a text
    that has repeated ones are sorted by hash, so that equal ones are neighbours, and back by position."""
    rest = [c for c in counted.columns if c != "grams"]
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    order = counted.select(*rest, F.when(F.size(F.array_distinct("grams")) < F.size("grams"), placed).alias("order"))
    twice = F.filter("order", lambda x, i: (x["g"] == F.get("order", i - 1)["g"]) | (x["g"] == F.get("order", i + 1)["g"]))
    hits = order.select(*rest, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("hits"))
    covers = F.transform("hits", lambda p, i: F.least(F.coalesce(F.get("hits", i + 1) - p, F.lit(width)), F.lit(width)))
    return hits.select(*rest, F.coalesce(F.aggregate(covers, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long").alias("n_repeat_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote. Most look for one kind of junk: they vote bad or abstain, as a text without
    that kind need not be good. Word length and text length also vote good."""
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    bad = lambda x, bound: F.when(x > bound, -1).otherwise(0)
    mean = F.col("word_chars") / words
    return {
        "symbols": bad(F.col("n_symbols") / words, 0.10),
        "repeats": bad(F.col("n_repeat_words") / words, 0.20),
        "lines": bad(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), 0.30),
        "capitals": bad(F.col("n_upper") / chars, 0.50),
        "shouting": bad(F.col("n_shouts") / words, 0.25),
        "digits": bad(F.col("n_digits") / chars, 0.40),
        "word_length": F.when(mean.between(3, 9), 1).when(~mean.between(2, 12), -1).otherwise(0),
        "length": F.when(F.col("n_words") >= 20, 1).when(F.col("n_words") < 5, -1).otherwise(0),
    }


def fit(patterns: DataFrame, rules: list[str], prior: float = 0.8, rounds: int = 15, weight: float = 0.02, better: float = 20.0) -> dict:
    """EM on (one column per rule, n): P(vote | class) of each rule. The prior share of good
    documents is a parameter: where rules abstain, votes can't tell it. The starting rates count as
    `weight` of the corpus, so that a rule that rarely votes isn't fitted to a few rows. What tells the two classes apart
    is the usual assumption that rules beat chance: a bad vote is at least `better` times as likely
    for a bad document as for a good one.

    Each round is one aggregate of the pattern table; only its sums come back.
    """
    # a bad vote starts as strong evidence, a good one as weak: junk passes most rules
    start = {1: {1: 0.8, -1: 0.01}, 0: {1: 0.7, -1: 0.3}}
    model = {"prior": prior, "p": {r: {c: dict(v) for c, v in start.items()} for r in rules}}
    for _ in range(rounds):
        p = posterior(model)
        sums = [F.sum(F.col("n") * p).alias("g"), F.sum("n").alias("n")]
        for r in rules:
            for v in (1, -1):
                hit = F.when(F.col(r) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit * p).alias(f"{r}{v}g"), F.sum(hit).alias(f"{r}{v}n")]
        s = patterns.agg(*sums).first()
        if not s["n"]:
            break
        good, n = float(s["g"]), float(s["n"])
        smooth = weight * n
        new = {"prior": prior, "p": {}}
        for r in rules:
            rates = {1: {}, 0: {}}
            for v in (1, -1):
                g, both = float(s[f"{r}{v}g"]), float(s[f"{r}{v}n"])
                rates[1][v] = (g + smooth * start[1][v]) / (good + smooth)
                rates[0][v] = (both - g + smooth * start[0][v]) / (n - good + smooth)
            rates[1][-1] = min(rates[1][-1], rates[0][-1] / better)
            new["p"][r] = rates
        moved = max(abs(new["p"][r][c][v] - model["p"][r][c][v]) for r in rules for c in (0, 1) for v in (1, -1))
        model = new
        if moved < 1e-4:
            break
    return model


def posterior(model: dict) -> Column:
    """P(good | votes) under a fitted model, as a column over the rules' votes."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, rates in model["p"].items():
        ratio = {v: math.log(max(rates[1][v], 1e-6) / max(rates[0][v], 1e-6)) for v in (1, -1)}
        odds = odds + F.when(F.col(r) == 1, ratio[1]).when(F.col(r) == -1, ratio[-1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, width: int = 5, min_words: int = 10, max_repeat_percent: int = 20, threshold: float = 0.5) -> DataFrame:
    """The statistics, the votes, the posterior and the verdict of every row."""
    rules = votes()
    voted = materialize(statistics(docs, width).select("*", *[v.alias(f"vote_{r}") for r, v in rules.items()]), "votes")
    names = [f"vote_{r}" for r in rules]
    patterns = materialize(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    model = fit(patterns, names)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        voted.withColumn("posterior", posterior(model))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )
