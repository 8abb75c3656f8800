"""Sources and sinks."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_batch_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    missing = {"name", "url", "jurisdiction"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """jurisdiction, law, meta, section, n, text of <folder>/<jurisdiction>/<law>.txt; what precedes the first section is dropped."""
    files = spark.read.text(f"{folder}/*/*.txt", wholetext=True).withColumn("path", F.input_file_name())
    part = F.split(F.col("path"), "/")
    meta = F.map_from_entries(F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^# ([^:\n]+:[^\n]*)$"), F.lit(1)), lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))
    body = F.regexp_replace("value", r"(?m)^# [^:\n]+:[^\n]*\n?", "")
    pieces = F.split(body, r"(?m)^## ", -1)
    blocks = F.when(F.size(pieces) > 1, F.transform(F.slice(pieces, 2, F.size(pieces) - 1), lambda x: F.struct(F.trim(F.split_part(x, F.lit("\n"), F.lit(1))).alias("section"), _strip(F.regexp_replace(x, r"^[^\n]*\n?", "")).alias("text")))).otherwise(F.array(F.struct(F.lit("").alias("section"), _strip(body).alias("text"))))
    return files.select(F.element_at(part, -2).alias("jurisdiction"), F.regexp_replace(F.element_at(part, -1), r"\.txt$", "").alias("law"), meta.alias("meta"), F.posexplode(blocks).alias("n", "b")).select("jurisdiction", "law", "meta", "b.section", "n", "b.text")


def decode_bytes(content: Column) -> Column:
    """Text of bytes: UTF-8, else UTF-16, else Latin-1, which never fails."""

    @F.pandas_udf("string")
    def other(raw: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                return b.decode("utf-16")
            except UnicodeDecodeError:
                return b.decode("latin-1")

        return raw.map(one)

    as_text = F.decode(content, "UTF-8")
    return F.when(F.is_valid_utf8(content.cast("string")), as_text).otherwise(other(F.when(~F.is_valid_utf8(content.cast("string")), content)))


def read_binary_docs(spark: SparkSession, glob: str) -> DataFrame:
    """path, text, reason of files: text as it is, html without markup; for other known formats text is null and reason says why."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    parser = suffix.isin("pdf", "docx", "rtf")
    read = files.select("path", suffix.alias("suffix"), F.when(parser, F.concat(F.lit("no reader for "), suffix)).alias("reason"), decode_bytes(F.when(~parser, F.col("content"))).alias("text"))
    looks_html = F.col("suffix").isin("html", "htm") | (~F.col("suffix").isin("txt", "md") & F.col("text").rlike(r"(?i)^\s*(<!doctype html|<html)"))
    return read.select("path", F.when(looks_html, strip_markup(F.col("text"))).otherwise(F.col("text")).alias("text"), "reason")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript") and self.off:
            self.off -= 1

    def handle_data(self, data):
        if not self.off:
            self.parts.append(data)


def _text_of(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    lines = (x.strip() for x in "\n".join(p.parts).splitlines())
    return "\n".join(x for x in lines if x)


def strip_markup(html: Column) -> Column:
    """Text nodes by line, without scripts and styles, blank lines or edges; null stays null."""

    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.map(_text_of)

    return strip(html)


def html_to_text(pages: DataFrame) -> DataFrame:
    """page_id, text of pages(page_id, html); null counts as empty."""
    return pages.select("page_id", strip_markup(F.coalesce("html", F.lit(""))).alias("text"))


def findings_csv_rows(findings: DataFrame, names: DataFrame, ids: list | None = None) -> DataFrame:
    """The nine columns of the findings export, of all documents or those in ids; write with .write.csv(path, header=True). names(doc_id, name)."""
    rows = findings.filter(F.col("doc_id").isin(ids)) if ids else findings
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).join(names.select("doc_id", "name"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("analysis_id"), F.coalesce("name", F.lit("")).alias("document_name"), F.concat_ws("-", "doc_id", "k").alias("finding_id"), "category", "severity", F.format_string("%.2f", "confidence").alias("confidence"),
        F.regexp_replace(F.coalesce("excerpt", F.lit("")), "\n", " ").alias("excerpt"), "line_start", "line_end",
    )


def write_rows(rows: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """Writes an export: csv with a header and quoted line ends, json with a row a line, or parquet; mode "append" adds to a table."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"no writer for {kind}")
    writer = rows.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(kind).save(path)
