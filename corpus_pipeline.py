"""From raw documents to sampled piece ids in five stages, each one operator of termlake.llm.

Every stage takes what the one before kept, written and read again in between. All but the last
return the columns of documents. Rows without a doc_id can't be told apart: they pass stages 2 to
4 untouched. Rows that repeat a doc_id are one document, of which stage 2 keeps one row. Null and
empty texts fail the first stage. Extra columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.llm import decontam, near_dups, pieces, quality, repeats
from termlake.llm.common import materialize


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model rejects go."""
    i, k = fresh(docs, "rejected_id"), fresh(docs, "rejected_key")
    rejected = quality.judged(docs).filter("not kept").select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(rejected, docs["doc_id"].eqNullSafe(F.col(i)) & (key == F.col(k)), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays."""
    gone = near_dups.near_duplicates(docs, width=5, percent=80, bands=25, rows=5).filter("not kept").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti")
    # of rows that repeat a doc_id with another text, the one with the smallest hash of its values stays, on every run
    mark, name = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), fresh(docs, "least_mark")
    least = kept.groupBy("doc_id").agg(F.min(mark).alias(name))
    known = kept.join(least, "doc_id").filter(mark == F.col(name)).dropDuplicates(["doc_id"])
    return known.select([F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id is null"))


def suffix_arrays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that occurred before are cut out of the texts."""
    name = fresh(docs, "struck_text")
    struck = repeats.remove_repeats(docs, length=100, as_text=True).select("doc_id", F.col("kept").alias(name))
    left = {"text": F.coalesce(name, "text"), "n_chars": F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length(name))}
    return docs.join(struck, "doc_id", "left").select(*[left.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth stands in the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontam.contamination(docs, benchmark).filter("contaminated").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document that is left."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_arrays", suffix_arrays),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Sampling and the label model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
