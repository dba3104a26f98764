"""Connected components as Spark joins: alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """From links (a, b) of longs: (node, component), component being the smallest node reachable, a row for each node
    that has a link to another one. Links to itself, repeated links and links with a null are of no effect.

    A round is two joins and rewrites the links so that each node points to a smaller one; the number of rounds grows
    as the square of the logarithm of the nodes. Nodes with very many links are no single task's work: minima are
    partial aggregates, and the join of a node with its minimum reads two tables, so that Spark can split it. Each
    round's links are a table in the shared folder, so a lost executor costs its tasks only.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    now = stage(now.distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "large-star")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now, last = stage(small, "small-star"), mark
        if (mark := _mark(now)) == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
