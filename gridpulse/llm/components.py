"""Connected components by alternating large-star and small-star rounds, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridpulse.llm.common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour; map-side aggregation makes a node with very many neighbours cheap."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge list (u, v); root is the least node of its component. Nodes without edges are absent."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, mark, i = scratch.write(down, "links-0"), None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark, i = state, i + 1
        now = scratch.write(_small(_large(now).distinct()).distinct(), f"links-{i}")
        scratch.drop(f"links-{i - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
