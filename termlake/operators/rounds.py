"""Rounds over stored tables: each reads and rewrites only what is due or decided."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.store import BucketedTable
from .reports import update_reviews
from .versions import due_items, merge_legacy_watch, watch_refresh

def refresh_watches(table: BucketedTable, fetched: DataFrame, now, default_cadence: int = 0) -> list[int]:
    """One round over a stored watch table: only buckets with due items are read in full and rewritten. See versions.watch_refresh()."""
    watch = table.read()
    return table.change(due_items(watch, now, default_cadence).select("id"), lambda old: watch_refresh(old, fetched, now, default_cadence=default_cadence).select(old.columns))


def decide_reviews(table: BucketedTable, decisions: DataFrame, now) -> list[int]:
    """Decisions(id, status, notes) taken into a stored review table; only buckets with decided reviews are rewritten."""
    return table.change(decisions, lambda old: update_reviews(old, decisions, now).select(old.columns))


def take_over_legacy(table: BucketedTable, legacy: DataFrame, now) -> list[int]:
    """Legacy watches merged into a stored watch table that is keyed by source_url; only buckets of their urls are rewritten. See versions.merge_legacy_watch()."""
    urls = legacy.selectExpr("url AS source_url").filter("source_url <> ''")
    return table.change(urls, lambda old: merge_legacy_watch(legacy, old, now)[0].select(old.columns))
