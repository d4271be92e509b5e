"""Helpers that keep large expressions from being built or evaluated more often than needed."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """Select ``keep`` and computed columns so that filters above do not copy the computations.

    Spark moves a filter below a projection by copying the filtered expression; for a long rule chain this doubles the
    work per row and inflates the plan.  A generator over one struct is evaluated once per row and stays in place.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Cache a column expression that only depends on hashable arguments, per running JVM."""
    cache: dict = {}

    @wraps(build)
    def get(*args):
        key = (id(SparkContext._jvm), *args)
        if key not in cache:
            cache[key] = build(*args)
        return cache[key]

    return get
