"""Connected components by alternating large-star and small-star steps.

Every step is an aggregate and a join over the edges; no step gathers the neighbours of a vertex, so a hub of a third of
all edges stays spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.session import written


def _leaders(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("leader"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _large_star(edges: DataFrame) -> DataFrame:
    around = _both_ways(edges)
    linked = around.join(_leaders(around), "u").filter("v > u")
    return linked.select(F.col("v").alias("u"), F.col("leader").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with ``u > v``: the smaller neighbours of ``u`` are those it lists."""
    linked = edges.join(edges.groupBy("u").agg(F.min("v").alias("leader")), "u")
    pairs = F.array(
        F.struct(F.col("v").alias("u"), F.col("leader").alias("v")), F.struct(F.col("u"), F.col("leader").alias("v"))
    )
    return linked.select(F.inline(pairs)).filter("u != v").distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """Rows ``(u, root)`` for every vertex but the smallest of its component; edges are ``(u, v)`` of one orderable type."""
    current = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges"
    )
    mark = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            return current.select("u", F.col("v").alias("root"))
        mark = tuple(now)
        current = written(_small_star(_large_star(current)), "edges")
