"""Versions of pages: pairs, differences, de-duplication and the watch table."""

from __future__ import annotations

import difflib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_severity
from ..sources.store import small_batches


def version_pairs(snapshots: DataFrame) -> DataFrame:
    """Each version with the one before it."""
    w = Window.partitionBy("url").orderBy("captured_at", "version")
    return snapshots.withColumn("old_text", F.lag("text").over(w)).withColumn("old_version", F.lag("version").over(w)).filter("old_version is not null")


def snapshot_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """pair, url, old_text, text of two tables (pair, url, text) of versions; two urls in a pair are an error."""
    j = a.select("pair", F.col("url").alias("old_url"), F.col("text").alias("old_text")).join(b.select("pair", "url", "text"), "pair")
    same = F.when(F.col("old_url").eqNullSafe(F.col("url")), F.col("url")).otherwise(F.raise_error(F.concat(F.lit("two urls in pair "), F.col("pair").cast("string"))))
    return j.select("pair", same.alias("url"), "old_text", "text")


def dedup_snapshots(new: DataFrame, store: DataFrame) -> DataFrame:
    """The first of each (url, content hash) that the store never had."""
    keyed = new.withColumn("content_hash", F.sha2("text", 256))
    first = Window.partitionBy("url", "content_hash").orderBy("captured_at", "version")
    fresh = keyed.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return fresh.join(store.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def snapshot_history(snapshots: DataFrame, url: str | None = None) -> DataFrame:
    """The snapshots of a url, or of every one, with their place: 1 is the newest."""
    chosen = snapshots if url is None else snapshots.filter(F.col("url") == url)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("captured_at"), F.desc("version"))))


TOKEN = r"""\b\w+\b|[.,:;!?"']"""


def tokenize_with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line (from 1), n (from 0 within the line), token: words and single marks."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\r\n|[\n\r]", -1)).alias("at", "row"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line"), F.posexplode(F.regexp_extract_all("row", F.lit("(?U)" + TOKEN), F.lit(0))).alias("n", "token"))


#: Bytes of texts that a task sends its Python worker at once, and characters of what the worker holds before it sends it back.
_HELD = 2 << 20
#: Rows that it holds.
_ROWS = 20_000

_ROLL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint32)


def content_chunks(text: str | None) -> list[bytes]:
    """The text in pieces of some 32 words that end at white space, where a hash of the eight bytes up to there says so.

    Where a piece ends depends on what stands there only, so what two versions share is cut alike, wherever it moved.
    """
    raw = np.frombuffer((text or "").encode(), np.uint8)
    h = np.zeros(len(raw), np.uint32)
    for j, w in enumerate(_ROLL):
        h[j:] += raw[: max(0, len(raw) - j)] * w
    cuts = (np.flatnonzero(((raw == 0x20) | (raw == 0x0A)) & ((h * np.uint32(0x9E3779B1)) >> np.uint32(27) == 0)) + 1).tolist()
    whole = raw.tobytes()
    return [whole[i:j] for i, j in zip([0, *cuts], [*cuts, len(whole)], strict=True) if i < j]


def changed_parts(pairs: DataFrame) -> DataFrame:
    """url, version, old_part, new_part: pieces of the old and the new text that the other doesn't have, or not as often; pairs that share all pieces send nothing.

    Pieces are compared within the row, so what didn't change goes no further.
    """

    def differ(batches):
        for batch in batches:
            url, version, olds, news = (batch.column(c) for c in ("url", "version", "old_text", "text"))
            rows, parts, size = [], ([], []), 0

            def made():
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([url.take(at), version.take(at), *(pa.array(p, pa.string()) for p in parts)], ["url", "version", "old_part", "new_part"])

            for i in range(batch.num_rows):
                a, b = Counter(content_chunks(olds[i].as_py())), Counter(content_chunks(news[i].as_py()))
                less, more = (b"".join(x.elements()).decode() for x in (a - b, b - a))
                if less or more:
                    rows.append(i)
                    parts[0].append(less)
                    parts[1].append(more)
                    size += len(less) + len(more)
                if size >= _HELD:
                    yield made()
                    rows, parts, size = [], ([], []), 0
            yield made()

    small_batches(pairs.sparkSession, _HELD)
    slim = pairs.select("url", F.col("version").cast("long").alias("version"), "old_text", "text").filter(~F.col("text").eqNullSafe(F.col("old_text")))
    return slim.mapInArrow(differ, "url string, version long, old_part string, new_part string").withColumn("version", F.col("version").cast(pairs.schema["version"].dataType))


def token_bag_diff(pairs: DataFrame) -> DataFrame:
    """url, version, token, delta, severity: tokens that a version has more or less of than the one before.

    Only tokens of changed_parts() are shuffled: pieces end at white space, which no token holds, so what both versions have
    adds nothing to a difference.
    """
    marked = changed_parts(pairs).select("url", "version", F.explode(F.array(F.struct(F.col("new_part").alias("part"), F.lit(1).alias("n")), F.struct(F.col("old_part").alias("part"), F.lit(-1).alias("n")))).alias("p"))
    each = marked.select("url", "version", F.explode(F.regexp_extract_all("p.part", F.lit("(?U)" + TOKEN), F.lit(0))).alias("token"), "p.n")
    delta = each.groupBy("url", "version", "token").agg(F.sum("n").alias("delta")).filter("delta <> 0")
    return delta.withColumn("severity", token_severity(F.lower("token")))


def _lines(text: str | None) -> list[str]:
    return (text or "").splitlines()


def _tokens(text: str | None) -> list[tuple[str, int]]:
    return [(t, k) for k, line in enumerate(_lines(text), 1) for t in _CUT.findall(line)]


_CUT = re.compile(TOKEN)


def token_diff(pairs: DataFrame) -> DataFrame:
    """url, version, n, token, line, type, severity: aligned token changes of each pair; Spark deals the pairs.

    The alignment is difflib's, with its usual treatment of very common tokens; its time can grow with the square of a
    text. Pairs with equal texts give no rows and no work.
    """

    names = ["url", "version", "n", "token", "line", "type"]

    def align(frames):
        for f in frames:
            rows = []
            for url, version, old, new in zip(f["url"], f["version"], f["old_text"], f["text"], strict=True):
                a, b = _tokens(old), _tokens(new)
                n = 0
                for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, [t for t, _ in a], [t for t, _ in b]).get_opcodes():
                    if op != "equal":
                        for kind, part in (("removed", a[i1:i2]), ("added", b[j1:j2])):
                            for t, line in part:
                                rows.append((url, version, n, t, line, kind))
                                n += 1
                                if len(rows) >= _ROWS:
                                    yield pd.DataFrame(rows, columns=names)
                                    rows = []
            yield pd.DataFrame(rows, columns=names)

    small_batches(pairs.sparkSession, _HELD)
    changed = pairs.filter(~F.col("text").eqNullSafe(F.col("old_text"))).select("url", "version", "old_text", "text")
    return changed.mapInPandas(align, "url string, version int, n int, token string, line int, type string").withColumn("severity", token_severity(F.lower("token")))


def diff_severity_summary(diff: DataFrame) -> DataFrame:
    """url, version, change_count, high, medium, low over the changed tokens of token_diff()."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return diff.groupBy("url", "version").agg(F.count("*").alias("change_count"), *map(count, ("high", "medium", "low")))


def line_diff(pairs: DataFrame, max_lines: int = 8) -> DataFrame:
    """url, version, change_count, summary of each pair: lines added and removed, and the first of them as a unified diff shows them."""

    def compare(frames):
        for f in frames:
            rows = []
            for url, version, old, new in zip(f["url"], f["version"], f["old_text"], f["text"], strict=True):
                shown = list(difflib.unified_diff(_lines(old), _lines(new), lineterm=""))
                signs = [x for x in shown if x[:1] in "+-"]
                n = sum(not x.startswith(("+++", "---")) for x in signs)
                rows.append((url, version, n, "\n".join([x for x in signs if x[1:].strip()][:max_lines]).strip()))
            yield pd.DataFrame(rows, columns=["url", "version", "change_count", "summary"])

    small_batches(pairs.sparkSession, _HELD)
    return pairs.select("url", "version", "old_text", "text").mapInPandas(compare, "url string, version int, change_count int, summary string")


def significant_changes(versions: DataFrame, findings: DataFrame, least: float = 1.0) -> DataFrame:
    """url, version, delta, n_new_high of versions(url, version, old_version, risk, old_risk) whose risk moved by `least` or that have a new High finding.

    findings(url, version, category, severity).
    """
    high = findings.filter("severity = 'High'").select("url", "version", "category").distinct()
    pairs = versions.select("url", "version", "old_version")
    before = pairs.join(high.withColumnRenamed("version", "old_version"), ["url", "old_version"]).select("url", "version", "category")
    fresh = pairs.join(high, ["url", "version"]).select("url", "version", "category").join(before, ["url", "version", "category"], "left_anti").groupBy("url", "version").agg(F.count("*").alias("n_new_high"))
    n = F.coalesce("n_new_high", F.lit(0))
    return versions.join(fresh, ["url", "version"], "left").select("url", "version", F.bround(F.col("risk") - F.col("old_risk"), 2).alias("delta"), n.alias("n_new_high")).filter((F.abs("delta") >= least) | (F.col("n_new_high") > 0))


def cadence(default: int = 0) -> Column:
    return F.when(F.col("check_frequency") > 0, F.col("check_frequency")).otherwise(F.lit(default))


def next_check_at(default: int = 0) -> Column:
    """Null for what is switched off, has no cadence or was never checked."""
    on = F.coalesce("enabled", F.lit(True)) & (cadence(default) > 0)
    return F.when(on, F.col("last_checked") + F.make_dt_interval(secs=cadence(default)))


def due_items(watch: DataFrame, now, default_cadence: int = 0) -> DataFrame:
    every = cadence(default_cadence)
    due = F.col("last_checked").isNull() | (F.col("last_checked") + F.make_dt_interval(secs=every) <= now)
    return watch.filter(F.coalesce("enabled", F.lit(True)) & (every > 0) & due & F.col("source_url").isNotNull())


def watchlist_listing(watch: DataFrame, default_cadence: int = 0) -> DataFrame:
    return watch.withColumn("next_check_at", next_check_at(default_cadence)).orderBy(F.desc_nulls_last("last_checked"), "id")


def watch_refresh(watch: DataFrame, fetched: DataFrame, now, keep: int = 50_000, default_cadence: int = 0) -> DataFrame:
    """The watch table after a round: due items take what was fetched(url, text, ok, risk).

    Of several fetches of a url the one with the greatest text hash counts, so that no item is doubled; an item without
    a fetch has failed. The lines that changed are counted for those whose hash did.
    """
    one = fetched.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    one = one.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("ok"), F.desc("hash")))).filter("n = 1").drop("n")
    due = due_items(watch, now, default_cadence).select("id").withColumn("due", F.lit(True))
    j = watch.join(due, "id", "left").join(one, watch["source_url"] == one["url"], "left")
    is_due, ok = F.coalesce("due", F.lit(False)), F.coalesce("ok", F.lit(False))
    take = is_due & ok
    changed = F.col("last_hash").isNotNull() & (F.col("last_hash") != F.col("hash"))
    differs = j.filter(take & changed).select(F.col("id").cast("string").alias("url"), F.lit(0).alias("version"), F.col("last_text").alias("old_text"), "text")
    lines = line_diff(differs).select(F.col("url").cast(watch.schema["id"].dataType).alias("id"), F.col("change_count").alias("n_lines"), "summary")
    j = j.join(lines, "id", "left")
    own = lambda c, new: F.when(take, new).otherwise(F.col(c)).alias(c)
    updated = take & changed
    return j.select(
        "id", "source_url", "enabled", "check_frequency",
        F.when(updated, "Updated").when(take, "No Changes").when(is_due, "Check Failed").otherwise(F.col("status")).alias("status"),
        F.when(is_due, now).otherwise(F.col("last_checked")).alias("last_checked"),
        F.when(updated, now).otherwise(F.col("changes_since")).alias("changes_since"),
        own("change_count", F.when(changed, F.coalesce("n_lines", F.lit(0))).otherwise(0)),
        own("change_summary", F.when(changed, F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise("Policy updated.")).otherwise("")),
        own("last_hash", F.col("hash")), own("risk_delta", F.coalesce(F.bround(F.col("risk") - F.col("last_risk"), 2), F.lit(0.0))), own("last_risk", F.col("risk")), own("last_text", F.substring(F.coalesce("text", F.lit("")), 1, keep)),
    )


# Spellings of a switch.
ON, OFF = ["true", "1", "yes", "on", "enabled"], ["false", "0", "no", "off", "disabled"]


def cast_enabled(raw: Column) -> Column:
    """Null is on, an unknown spelling off."""
    return F.when(raw.isNull(), True).otherwise(F.lower(F.trim(raw)).isin(ON))


def vendor_from_url(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(F.length(host) > 0, host).otherwise("Unknown vendor")


def merge_legacy_watch(legacy: DataFrame, watch: DataFrame, now, usual: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """(watch table with the rows of a legacy one, one row of counts: updated, inserted, skipped).

    Legacy rows of one url are taken in the order of their ids: the first user counts, the first cadence that isn't the
    usual one, off if any is off, the first creation time. Rows without url are skipped. A url that is watched takes
    from them what it lacks; watch has one row a url.
    """
    old = legacy.withColumn("on", cast_enabled(F.col("enabled"))).withColumn("every", F.coalesce(F.nullif("check_frequency", F.lit(0)), F.lit(usual)))
    first = lambda c, when: F.min_by(c, F.when(when, F.col("id")))
    folded = old.filter("url <> ''").groupBy("url").agg(
        first("user_id", F.coalesce("user_id", F.lit("")) != "").alias("o_user"), first("every", F.col("every") != usual).alias("o_every"), F.bool_and("on").alias("o_on"), F.min_by(F.coalesce("created_at", now), "id").alias("o_created"),
        F.count("*").alias("o_rows"),
    )
    j = watch.withColumn("known", F.lit(True)).join(folded, watch["source_url"] == folded["url"], "full")
    known, met = F.coalesce("known", F.lit(False)), F.col("url").isNotNull()
    usual_now = F.coalesce("check_frequency", F.lit(0)).isin(0, usual)
    every = F.when(usual_now & met, F.coalesce("o_every", F.lit(usual))).otherwise(F.col("check_frequency"))
    made = j.select(
        "id", F.when(known, F.col("vendor")).otherwise(vendor_from_url(F.col("url"))).alias("vendor"), F.coalesce("source_url", "url").alias("source_url"), F.coalesce("status", F.lit("No Changes")).alias("status"),
        F.coalesce("user_id", "o_user").alias("user_id"), F.when(known, F.when(met, every).otherwise(F.col("check_frequency"))).otherwise(F.coalesce("o_every", F.lit(usual))).alias("check_frequency"),
        F.when(known, F.when(met & F.col("enabled") & ~F.col("o_on"), False).otherwise(F.col("enabled"))).otherwise(F.col("o_on")).alias("enabled"), F.coalesce("created_at", "o_created").alias("created_at"),
        known.alias("known"), met.alias("met"), F.col("check_frequency").alias("was_every"), F.col("enabled").alias("was_on"), F.col("created_at").alias("was_created"), F.col("user_id").alias("was_user"),
    )
    moved = ~(F.col("user_id").eqNullSafe(F.col("was_user")) & F.col("check_frequency").eqNullSafe(F.col("was_every")) & F.col("enabled").eqNullSafe(F.col("was_on")) & F.col("created_at").eqNullSafe(F.col("was_created")))
    made = made.withColumn("moved", moved)
    skipped = legacy.agg(F.count_if(F.coalesce("url", F.lit("")) == "").alias("skipped"))
    counts = made.agg(F.count_if(F.col("known") & F.col("met") & F.col("moved")).alias("updated"), F.count_if(~F.col("known")).alias("inserted")).crossJoin(skipped)  # one row each
    return made.drop("known", "met", "moved", "was_every", "was_on", "was_created", "was_user"), counts
