"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelmesh.runtime import Rolling


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> tuple[DataFrame, Rolling]:
    """(node, root) for every node of ``links`` (a, b), with root the smallest node of its component.

    Every step is a minimum per node and a join, so a node with very many links is combined before the shuffle and its
    join partition can be split; nothing but a count and a checksum reaches the driver. The second result owns the
    written generations.
    """
    rolling = Rolling("components")
    edges = rolling.push(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = rolling.push(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _state(following)
        edges = following
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), rolling


def smallest_key(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id): the smallest ``key`` of all ``rows`` (key, node) in the node's component."""
    nodes = rows.groupBy("node").agg(F.min("key").alias("key"))
    rooted = nodes.join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("key").alias("component_id"))
    return rooted.join(best, "root").select("node", "component_id")
