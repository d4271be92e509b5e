"""Bounded history per key: append, read the newest, clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.operators.ranking import top_n


def append(
    history: DataFrame,
    entries: DataFrame,
    key: str = "repo_id",
    order: str = "ord",
    keep: int = fixed.MEMORY_ENTRIES,
    ts: str = "ts",
) -> DataFrame:
    """Add entries and keep the newest ``keep`` per key; entries whose time ``ts`` is null get the current one."""
    if ts in entries.columns:
        entries = with_timestamp(entries, ts, F.current_timestamp().cast(entries.schema[ts].dataType))
    return newest(history.unionByName(entries, allowMissingColumns=True), key, order, keep).drop("rank")


def newest(history: DataFrame, key: str = "repo_id", order: str = "ord", n: int = fixed.RECENT_ENTRIES) -> DataFrame:
    """Newest entries per key by insertion order; ``rank`` 1 is the newest."""
    return top_n(history, [key], [F.col(order).desc()], n)


def with_timestamp(entries: DataFrame, ts: str = "ts", now: Column | None = None) -> DataFrame:
    """Entries without a time get the current one."""
    return entries.withColumn(ts, F.coalesce(F.col(ts), F.current_timestamp() if now is None else now))


def clear(history: DataFrame, keys: DataFrame, key: str = "repo_id") -> DataFrame:
    """Drop the history of the given keys."""
    return history.join(keys.select(key).distinct(), key, "left_anti")
