"""Beta-binomial shrinkage of rates: moments of a prior, posterior means and a posterior bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a prior's strength, in observations.
WEAKEST, STRONGEST = 2.0, 200.0


def strength(groups: DataFrame, mean: Column) -> float:
    """Observations that the prior is worth, by moments: how far the groups' rates k / n spread beyond chance around ``mean``.

    ``groups`` has n and k. One aggregate; too few groups or no spread give the strongest prior.
    """
    row = groups.where("n > 0").agg(
        F.count("*").cast("double").alias("groups"),
        F.sum("n").cast("double").alias("total"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2)).alias("spread"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("chance"),
    ).first()
    if not row["total"] or row["groups"] < 2 or not row["chance"]:
        return STRONGEST
    variance, extra = row["chance"] / row["total"], row["groups"] - 1
    room = row["total"] - row["squares"] / row["total"] - extra
    share = (row["spread"] - extra * variance) / (room * variance) if room > 0 else 0.0
    return STRONGEST if share <= 1 / (1 + STRONGEST) else max(WEAKEST, 1 / share - 1)


def posterior_mean(prior_mean: Column, prior_strength: float, n: Column, k: Column) -> Column:
    return (prior_mean * prior_strength + k) / (n + prior_strength)


def lower_bound(prior_mean: Column, prior_strength: float, n: Column, k: Column, z: float) -> Column:
    """Posterior mean less ``z`` posterior standard deviations."""
    mean = posterior_mean(prior_mean, prior_strength, n, k)
    return mean - z * F.sqrt(mean * (1 - mean) / (n + prior_strength + 1))
