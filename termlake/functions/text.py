"""Text columns: clean-up, lines, words, hashes, chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import catalog

_EDGE = r"(?U)^\s+|\s+$"


def normalize_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n"), _EDGE, "")


def normalise_paste(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def number_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.format_string("%04d| %s", i + 1, x)), "\n")


def line_offsets(text: Column) -> Column:
    """Start of each line of a short text, in characters; for long texts see line_starts()."""
    lines = F.split(text, "\n", -1)
    step = F.aggregate(
        lines, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )
    return step["out"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def token_severity(token: Column) -> Column:
    return F.when(token.isin(catalog.CRITICAL_WORDS), "high").when(token.isin(catalog.MIDDLE_WORDS), "medium").otherwise("low")


def sanitize_codes(csv: Column, allowed: list[str]) -> Column:
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x.isin(allowed))


def valid_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def line_starts(docs: DataFrame) -> DataFrame:
    """doc_id, n, start: where each line begins, in characters; a running sum over the document's lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line")).select("doc_id", "n", (F.length("line") + 1).alias("size"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", "n", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))


def packed(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk) of lines packed greedily; each chunk begins with the lines before it that have `overlap` characters at most."""
    out, held, n, at = [], [], 0, 0
    for line in _LINE.findall(text):
        if held and n + len(line) > size:
            out.append((held[0][0], "".join(x for _, x in held)))
            k, n = len(held), 0
            while k and n + len(held[k - 1][1]) <= overlap:
                k -= 1
                n += len(held[k][1])
            held = held[k:]
        held.append((at, line))
        n += len(line)
        at += len(line)
    return [*out, (held[0][0], "".join(x for _, x in held))] if held else out


_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def chunk_text(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """doc_id, n, start, chunk: lines packed greedily, a longer line alone; whole trailing lines up to `overlap` are repeated."""

    def chunk(frames):
        for f in frames:
            rows = [(i, n, start, c) for i, t in zip(f["doc_id"], f["text"], strict=True) if t for n, (start, c) in enumerate(packed(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "start", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(chunk, "doc_id long, n int, start int, chunk string")


def section_chunks(sections: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """chunk_id, jurisdiction, law, section, status, text of sections(jurisdiction, law, section, n, text, meta): each chunk begins with its section's title."""
    keyed = sections.withColumn("doc_id", F.xxhash64("jurisdiction", "law", "n"))
    parts = chunk_text(keyed, size, overlap).withColumnRenamed("n", "part")
    j = parts.join(keyed.select("doc_id", "jurisdiction", "law", "section", "meta"), "doc_id")
    title = F.when(F.coalesce("section", F.lit("")) == "", F.col("chunk")).otherwise(F.concat("section", F.lit("\n"), "chunk"))
    return j.select(F.xxhash64("doc_id", "part").alias("chunk_id"), "jurisdiction", "law", "section", F.try_element_at("meta", F.lit("status")).alias("status"), title.alias("text"))


def truncate_text(text: Column, most: int = 50_000) -> Column:
    return F.substring(text, 1, most)


#: Networks that aren't public: first address and number of leading bits.
PRIVATE_NETWORKS = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16"]


def public_url(url: Column, networks: list[str] = PRIVATE_NETWORKS) -> Column:
    """A valid url whose host isn't an address of a private network; names are taken as they are."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    parts = F.split(F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), host), r"\.")
    number = sum((F.get(parts, k).cast("long") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0))
    private = F.lit(False)
    for x in networks:
        first, bits = x.split("/")
        low = sum(int(b) << (24 - 8 * k) for k, b in enumerate(first.split(".")))
        private = private | number.between(low, low + (1 << (32 - int(bits))) - 1)
    local = host.isin("localhost", "[::1]") | host.rlike(r"^\[f[cd][0-9a-f]{2}:")
    return valid_url(url) & ~F.coalesce(private, F.lit(False)) & ~F.coalesce(local, F.lit(False))
