"""Ranking and running totals per key that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their rank.

    Spark turns the rank filter into a group limit that also runs before the shuffle, so each map task sends at most
    ``n`` rows per key, whatever the size of the key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def running_total(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, limit: int | None = None
) -> DataFrame:
    """Sum of ``value`` up to and including each row, ordered by a unique column.

    A distributed prefix sum: rows are dealt by ranges of key and order that hold about equally many rows, whatever the order
    values, and written once.  Totals per key and range give each range its starting sum, then a window adds up inside the
    range.  No window holds more rows than a range has, or a key has ranges.  With ``limit`` the ranges that start above it
    are dropped before the second step (valid for values that are not negative).
    """
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], F.col(order)).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    ranges = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    if limit is not None:
        starts = starts.filter(F.col("_start") <= limit)
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(starts, [*keys, "_range"]).withColumn(out, F.col("_start") + F.sum(value).over(inside)).drop("_range", "_start")


def within_budget(df: DataFrame, keys: list[str], order: str, value: str, budget: int) -> DataFrame:
    """Rows in order until their sum would pass the budget; sizes are not negative, so the first overflow ends it."""
    return running_total(df, keys, order, value, "running", limit=budget).filter(F.col("running") <= budget)
