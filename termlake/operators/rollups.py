"""Portfolio figures, corpus comparison and evaluation against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def severity_counts(findings: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}")
    return findings.groupBy("doc_id").agg(*map(count, ("Critical", "High", "Medium", "Low")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("jurisdictions")))).alias("codes"))


def heatmap(rollups: DataFrame) -> DataFrame:
    """Mean score and sample count of each industry and jurisdiction on the axes; an empty cell is 0."""
    cells = rollups.groupBy("industry", "jurisdiction").agg(F.avg("crs").alias("mean"), F.count("*").alias("n"))
    # the roll-ups are read once: their cells, few, come as one row, and the axes are taken from it
    one = cells.agg(F.collect_list(F.struct("industry", "jurisdiction", "mean", "n")).alias("cells"))
    axis = lambda c: F.explode(F.array_distinct(F.transform("cells", lambda x: x[c]))).alias(c)
    axes = one.select("cells", axis("industry")).select("cells", "industry", axis("jurisdiction"))
    cell = F.get(F.filter("cells", lambda x: (x["industry"] == F.col("industry")) & (x["jurisdiction"] == F.col("jurisdiction"))), 0)
    return axes.select("industry", "jurisdiction", F.coalesce(cell["mean"], F.lit(0.0)).alias("mean"), F.coalesce(cell["n"], F.lit(0)).alias("n"))


def kpis(rollups: DataFrame, category: str = "category") -> DataFrame:
    """n, mean, percent_red (0.70 and more), percent_high (0.75 and more), n_minors and the commonest category, ties by name; one row."""
    n = F.greatest(F.count("*"), F.lit(1))
    s = rollups.agg(
        F.count("*").alias("n"), F.coalesce(F.avg("crs"), F.lit(0.0)).alias("mean"), (100.0 * F.count_if(F.col("crs") >= 0.7) / n).alias("percent_red"), (100.0 * F.count_if(F.col("crs") >= 0.75) / n).alias("percent_high"), F.count_if("minors").alias("n_minors")
    )
    top = rollups.groupBy(category).agg(F.count("*").alias("times")).agg(F.min_by(category, F.struct((-F.col("times")).alias("n"), F.col(category).alias("c"))).alias("top_category"))
    return s.crossJoin(top)  # one row each


def contribute_rollups(rows: DataFrame) -> DataFrame:
    """The rows of those who opted in; write with append."""
    return rows.filter(F.coalesce("optin", F.lit(False))).drop("optin")


def keyword_frequency(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def distribution_drift(a: DataFrame, b: DataFrame, bound: float = 0.7) -> DataFrame:
    """Cosine of two frequency tables (word, n); 0 if either is empty."""
    j = a.withColumnRenamed("n", "x").join(b.withColumnRenamed("n", "y"), "word", "full").fillna(0, ["x", "y"]).select(F.col("x").cast("double"), F.col("y").cast("double"))
    s = j.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"))
    cosine = F.coalesce(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0))
    return s.select(cosine.alias("cosine"), (cosine < bound).alias("drift"))


def confusion(gold: DataFrame, predicted: DataFrame, docs: DataFrame, categories: list[str]) -> DataFrame:
    """tp, fp, fn, tn per category; gold and predicted are (doc_id, category). True negatives follow from the number
    of documents, so documents and categories are never crossed."""
    g = gold.filter(F.col("category").isin(categories)).select("doc_id", "category").distinct().withColumn("g", F.lit(1))
    p = predicted.filter(F.col("category").isin(categories)).select("doc_id", "category").distinct().withColumn("p", F.lit(1))
    seen = g.join(p, ["doc_id", "category"], "full").groupBy("category").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    every = docs.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    n = docs.agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    full = every.join(seen, "category", "left").select("category", zero("tp"), zero("fp"), zero("fn")).crossJoin(n)
    return full.withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).drop("n")


def scores(confusion_: DataFrame) -> DataFrame:
    """Precision, recall, F1 and Cohen's kappa (0 where agreement by chance is total)."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    n = tp + fp + fn + tn
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    kappa = F.when(expected >= 1, 0.0).otherwise(((tp + tn) / n - expected) / (1 - expected))
    return confusion_.select("*", p.alias("precision"), r.alias("recall"), div(2 * p * r, p + r).alias("f1"), kappa.alias("kappa"))


def macro(scores_: DataFrame) -> DataFrame:
    """Means over all categories: macro_precision, macro_recall, macro_f1, macro_kappa."""
    return scores_.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "kappa")])


def kappa_pooled(confusion_: DataFrame) -> DataFrame:
    """Cohen's kappa over all pairs of document and category; 1 where agreement by chance is total, 0 without documents."""
    s = confusion_.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    gold, said = (tp + fn) / n, (tp + fp) / n
    expected = gold * said + (1 - gold) * (1 - said)
    return s.select(F.when(n == 0, 0.0).when(expected == 1, 1.0).otherwise(((tp + tn) / n - expected) / (1 - expected)).alias("kappa"))


def evaluate(gold: DataFrame, predicted: DataFrame, docs: DataFrame, categories: list[str]) -> DataFrame:
    """One row: macro precision, recall, F1 and kappa over the categories, and the pooled kappa."""
    c = confusion(gold, predicted, docs, categories)
    return macro(scores(c)).crossJoin(kappa_pooled(c).withColumnRenamed("kappa", "pooled_kappa"))  # one row each


def multiclass(pairs: DataFrame, labels: tuple = ("R", "Y", "G")) -> DataFrame:
    """category, n, macro_f1, kappa of pairs(category, gold, predicted) over the labels; agreement by chance of 1 counts as 0 in the divisor."""
    m = pairs.groupBy("category").agg(F.count("*").alias("n"), *[F.count_if((F.col("gold") == g) & (F.col("predicted") == p)).cast("double").alias(f"{g}{p}") for g in labels for p in labels])
    row = {x: sum(F.col(f"{x}{p}") for p in labels) for x in labels}
    col = {x: sum(F.col(f"{g}{x}") for g in labels) for x in labels}
    f1 = lambda x: F.when(row[x] + col[x] > 0, 2 * F.col(f"{x}{x}") / (row[x] + col[x])).otherwise(0.0)
    seen = sum(F.col(f"{x}{x}") for x in labels) / F.col("n")
    chance = sum(row[x] * col[x] for x in labels) / (F.col("n") * F.col("n"))
    return m.select("category", "n", (sum(map(f1, labels)) / len(labels)).alias("macro_f1"), ((seen - chance) / F.when(chance == 1, 1.0).otherwise(1 - chance)).alias("kappa"))


def vendor_compare(analyses: DataFrame, findings: DataFrame, vendors: list[str]) -> DataFrame:
    """metric, a column for each vendor, best: mean risk and findings by category, lower is better, ties by name."""
    risk = analyses.filter(F.col("vendor").isin(vendors)).groupBy("vendor").agg(F.bround(F.avg("risk_score"), 6).alias("value")).select("vendor", F.lit("risk").alias("metric"), "value")
    counts = findings.join(analyses.select("doc_id", "vendor"), "doc_id").filter(F.col("vendor").isin(vendors)).groupBy("vendor", "category").agg(F.count("*").cast("double").alias("value"))
    every = risk.unionByName(counts.select("vendor", F.concat(F.lit("findings: "), "category").alias("metric"), "value"))
    wide = every.groupBy("metric").pivot("vendor", vendors).agg(F.first("value")).fillna(0.0, [v for v in vendors])
    order = F.array_min(F.array(*[F.struct(F.col(f"`{v}`").alias("value"), F.lit(v).alias("vendor")) for v in vendors]))
    return wide.withColumn("best", order["vendor"])
