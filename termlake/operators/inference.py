"""Jurisdiction, document type and industry from a URL and a text, in one projection.

Each kind of signal is an array of (label, code) for what occurs, in table order; they are made once
and read for both the codes and the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from .rules import folded, java

_SIGNAL = "array<struct<label:string,code:string>>"
BUCKETS = ["tld", "statute", "regulator", "geography", "currency_language", "language_heuristic"]


def _full(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(_full(url), F.lit("HOST"))), r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(_full(url), F.lit("PATH"))), F.lit(""))


def _signal(hit: Column, label: str, code: str) -> Column:
    return F.when(hit, F.struct(F.lit(label).alias("label"), F.lit(code).alias("code")))


def _present(signals: list[Column]) -> Column:
    return F.filter(F.array(*signals), lambda x: x.isNotNull())


def _named(text: Column, low: Column, name: str, suffix: str = "", fold: bool = True) -> Column:
    """Whether the name occurs; the plain text is looked for first, as it is cheaper and most texts lack it."""
    plain = low.contains(name.lower()) if fold else text.contains(name)
    pattern = catalog.name(name)
    if suffix:
        pattern = catalog.name(name).removesuffix(r"\b") + suffix + r"\b"
    return plain & text.rlike(java(pattern, fold))


def suffix_signal(host: Column) -> Column:
    """The first suffix in table order, as an array of one or none."""
    first = F.coalesce(*[_signal(host.endswith(s), s, j) for s, j in catalog.SUFFIXES.items()])
    return F.when(first.isNull(), F.array().cast(_SIGNAL)).otherwise(F.array(first))


def statute_signals(text: Column, low: Column) -> Column:
    law, hints, code = catalog.HINTED
    hinted = _named(text, low, law) & (_named(text, low, hints[0]) | _named(text, low, hints[1]) | F.coalesce(text.rlike(java(r"\bSB\s*205\b")), F.lit(False)))
    # a number may follow the two letters after any white space
    spaced = {"SB 205": text.rlike(java(r"\bSB\s*205\b"))}
    named = [_signal(spaced.get(n, _named(text, low, n)), n, j) for n, j in catalog.STATUTES.items() if n != "SB205"]
    return _present([*named, _signal(hinted, f"{law} with a hint", code)])


def regulator_signals(text: Column, low: Column) -> Column:
    return _present([_signal(_named(text, low, n, fold=False), n, j) for n, j in catalog.REGULATORS.items()])


def resident_signals(text: Column, low: Column) -> Column:
    return _present([_signal(_named(text, low, n, "" if n == "European Economic Area" else "s?"), n, j) for n, j in catalog.RESIDENTS.items()])


def currency_signals(text: Column, low: Column) -> Column:
    """A currency's sign together with one of its phrases."""
    return _present([_signal(text.contains(sign) & text.rlike(java(catalog.phrase(*phrases))), f"{sign} with a phrase", j) for sign, phrases, j in catalog.CURRENCIES])


def language_signals(low: Column) -> Column:
    hits = sum((low.contains(w).cast("int") for w in catalog.EU_WORDS), F.lit(0))
    return _present([_signal(hits >= 2, "words of European languages", "GDPR")])


def infer_doc_type(url: Column, text: Column) -> Column:
    """By path, then by what the text speaks of; null where there is neither."""
    path, low = url_path(url), F.lower(text)
    has = {t: F.coalesce(F.greatest(*[low.contains(p) for p in phrases]), F.lit(False)) for t, phrases in catalog.TEXT_TYPES.items()}
    privacy, terms = has["Privacy Policy"], has["Terms of Service"]
    known = F.coalesce(F.length(url) > 0, F.lit(False)) | F.coalesce(F.length(text) > 0, F.lit(False))
    found = F.coalesce(*[F.when(path.contains(p), F.lit(t)) for p, t in catalog.PATH_TYPES], F.when(privacy & terms, F.lit("Combined")).when(terms, F.lit("Terms of Service")), F.lit("Privacy Policy"))
    return F.when(known, found)


def infer_industry(url: Column, text: Column) -> Column:
    """By host, then by words of the url and the whole text, in table order; null where there is neither."""
    host = F.coalesce(url_host(url), F.lit(""))
    both = F.lower(F.concat_ws(" ", url, text))
    of_host = [F.when(host.isin(hosts) | F.greatest(*[host.endswith(f".{h}") for h in hosts]), F.lit(i)) for i, hosts in catalog.HOST_INDUSTRIES.items()]
    words = []
    for i, w in catalog.INDUSTRIES.items():
        hit = both.rlike(f"(?Ud){catalog.phrase(*w)}")
        words.append(F.when(hit | host.contains(".edu") if i == "Education" else hit, F.lit(i)))
    known = F.coalesce(F.length(url) > 0, F.lit(False)) | F.coalesce(F.length(text) > 0, F.lit(False))
    return F.when(known, F.coalesce(*of_host, F.when(host.endswith(".gov") | host.contains(".gov."), F.lit("General")), *words, F.lit("General")))


def infer_all(docs: DataFrame) -> DataFrame:
    """doc_id, host, jurisdictions, doc_type, industry, location_needed, detected_signals of docs(doc_id, url, text).

    Jurisdictions come by suffix, statute, regulator, residents and currency, without repeats; words of
    European languages count only where none of these fired. detected_signals has the labels by kind.
    """
    base = docs.select("doc_id", "url", "text", url_host(F.col("url")).alias("host"), folded(F.col("text")).alias("low"))
    text, low = F.coalesce("text", F.lit("")), F.coalesce("low", F.lit(""))
    seen = base.select(
        "doc_id", "url", "text", "host", "low", suffix_signal(F.col("host")).alias("tld"), statute_signals(text, low).alias("statute"), regulator_signals(text, low).alias("regulator"),
        resident_signals(text, low).alias("geography"), currency_signals(text, low).alias("currency_language"),
    )
    sure = F.concat(*BUCKETS[:-1])
    seen = seen.withColumn("language_heuristic", F.when(F.size(sure) == 0, language_signals(F.coalesce(F.lower("text"), F.lit("")))).otherwise(F.array().cast(_SIGNAL)))
    labels = F.array(*[F.struct(F.lit(b).alias("key"), F.transform(b, lambda x: x["label"]).alias("value")) for b in BUCKETS])
    codes = F.array_distinct(F.transform(F.concat(*BUCKETS), lambda x: x["code"]))
    return seen.select(
        "doc_id", "host", codes.alias("jurisdictions"), infer_doc_type(F.col("url"), F.col("text")).alias("doc_type"), infer_industry(F.col("url"), F.col("text")).alias("industry"),
        (F.size(codes) == 0).alias("location_needed"),
        F.map_from_entries(F.filter(F.concat(labels, F.array(F.struct(F.lit("fallback").alias("key"), F.when(F.size(codes) == 0, F.array(F.lit("no signals"))).otherwise(F.array().cast("array<string>")).alias("value")))), lambda x: F.size(x["value"]) > 0)).alias("detected_signals"),
    )
