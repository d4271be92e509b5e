"""From review answers to changed files and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import review


def latest_reviews(responses: DataFrame, order: str) -> DataFrame:
    """The last answer of each repository, parsed and normalised."""
    last = responses.groupBy("repo_id").agg(F.max_by("raw", order).alias("raw"))
    return review.reviews(last)


def outcomes(repos: DataFrame, files: DataFrame, fixes: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Counts and status per repository.  ``repos`` may list repositories without any code file."""
    items = review.improvements(reviewed, ["repo_id"])
    applied = review.improvements_to_files(items, files.select("repo_id", "path", F.lit(None).alias("content")))
    count = lambda df, name: df.groupBy("repo_id").agg(F.count("*").alias(name))
    counts = repos.select("repo_id").distinct()
    for df, name in (
        (files, "n_files"),
        (fixes, "n_fixes"),
        (items, "n_improvements"),
        (applied.filter("found"), "n_changes"),
    ):
        counts = counts.join(count(df, name), "repo_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return review.run_status(counts)
