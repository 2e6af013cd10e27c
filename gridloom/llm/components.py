"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(near: DataFrame) -> DataFrame:
    """For each node with its neighbours ``near`` (a, b): link them to the least of them all.

    The least is pre-aggregated by the map tasks. A node with very many neighbours meets it in one task: Spark doesn't
    split a join whose other side is an aggregate."""
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.join(least, "a").select(F.col("m").alias("a"), "b", F.col("a").alias("u"))


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (least node reachable) of every node in ``edges`` (a, b); any node type with an order.

    Each round links every node's larger neighbours, then its smaller ones, to the least node in sight, which
    keeps the components and ends in stars after a logarithmic number of rounds; the edges of a round are
    written to the shared folder, so that no lineage grows. Raises if ``most`` rounds don't suffice.
    """
    spark = edges.sparkSession
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).alias("mark")
    seen = edges.select(mark).first()
    for _ in range(most):
        if not seen.mark.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        larger = _star(_both_ways(edges)).where("b > u").select(F.col("b").alias("a"), F.col("a").alias("b"))
        larger = larger.where("a <> b").distinct()
        star = _star(larger)
        smaller = star.select(F.col("b").alias("x"), F.col("a").alias("m")).union(star.select(F.col("u").alias("x"), F.col("a").alias("m")))
        before, edges = edges, stored(smaller.where("x <> m").distinct().select(F.col("x").alias("a"), F.col("m").alias("b")), "edges")
        forget(before)
        now = edges.select(mark).first()
        if now == seen:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"{spark.sparkContext.appName}: components did not settle in {most} rounds")


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, component) after edges (a, b) between components; nodes without label are their own component.

    Only the components that have edges are searched; the rest keep theirs."""
    found = connected_components(edges)
    old = labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return stored(old.select("node", F.coalesce("to", "component").alias("component")).union(found.join(labels, "node", "left_anti")), "labels")
