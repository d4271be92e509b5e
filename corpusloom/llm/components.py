"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import saved


def _mins(pairs: DataFrame) -> DataFrame:
    """The smallest node next to each node. Stored, so that the join back can split a node with very many links."""
    return saved(pairs.groupBy("u").agg(F.min("v").alias("m")), "mins")


def _settled(edges: DataFrame) -> bool:
    """True if every node has one link down or is the end of links, never both: then each link ends in its component's smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    counts = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counts.where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1))).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for each node that has a link; ``comp`` is the smallest node of its component.

    Every round is a partial minimum and an equality join, both of which split hubs; the number of rounds grows with the
    logarithm of the longest path. Links with a null end are ignored.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = saved(links.where((F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = saved(large, "large")
        small = large.join(_mins(large), "u")
        edges = saved(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return saved(members.unionByName(members.select(F.col("comp").alias("node"), "comp").distinct()), "components")
