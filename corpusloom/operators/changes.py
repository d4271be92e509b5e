"""Merge changed or repaired bodies into the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.lines import with_meaningful


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each file; earlier ones are lost, because each was made from the original text."""
    return changes.groupBy("repo_id", F.col("file").alias("path")).agg(
        F.max_by(F.struct("content", "description"), "ord").alias("_c")
    ).select("repo_id", "path", F.col("_c.content").alias("new_content"), "_c.description")


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The corpus after all changes; a change to an unknown path creates the file."""
    merged = files.select("repo_id", "path", "content").join(latest_changes(changes), ["repo_id", "path"], "full_outer")
    return merged.select(
        "repo_id",
        "path",
        F.coalesce("new_content", "content").alias("content"),
        F.col("new_content").isNotNull().alias("modified"),
    )


def apply_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """The corpus with the bodies of ``fixes(repo_id, path, fixed_content)``."""
    return files.join(fixes.select("repo_id", "path", "fixed_content"), ["repo_id", "path"], "left").select(
        "repo_id",
        "path",
        F.coalesce("fixed_content", "content").alias("content"),
        F.col("fixed_content").isNotNull().alias("modified"),
    )


def skip_trivial_changes(pairs: DataFrame, old: str = "old_text", new: str = "new_text") -> DataFrame:
    """Keep the current text where the new one is no meaningful change; ``final_text`` and ``meaningful``."""
    return with_meaningful(pairs, old, new).withColumn(
        "final_text", F.when(F.col("meaningful"), F.col(new)).otherwise(F.col(old))
    )
