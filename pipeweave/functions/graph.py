"""Graphs as two tables: edges (source, target, ...) and nodes (name, presence, depth)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.operators.rel import stable


def graph(edges: DataFrame) -> DataFrame:
    """All node names of the edges."""
    return edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct().withColumn("presence", F.lit("member"))


def uplinks(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that leave the seed (``name``)."""
    return edges.join(seed.select(F.col("name").alias("source")).distinct(), "source", "left_semi").select(*edges.columns)


def downlinks(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that reach the seed."""
    return edges.join(seed.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select(*edges.columns)


def expand(seed: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """Breadth first from the seed: ``name``, ``depth`` of first reach, ``presence`` (seed or expanded)."""
    hops = []
    if direction in ("up", "both"):
        hops.append(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    if direction in ("down", "both"):
        hops.append(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))
    step = hops[0] if len(hops) == 1 else hops[0].union(hops[1])
    seen = seed.select("name").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        reached = front.join(step, front["name"] == step["a"]).select(F.col("b").alias("name")).distinct()
        front = stable(reached.join(seen, "name", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen.withColumn("presence", F.when(F.col("depth") == 0, "retrieved").otherwise("expanded"))
