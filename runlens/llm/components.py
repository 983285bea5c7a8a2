"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import saved


def _toward_minimum(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Edges are (a, b) with a > b; nodes are told their smallest neighbour by a partial aggregate."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Rows and a sum of hashes, to see that a step changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of a long edge table ``a``, ``b``; the component is its smallest node.

    Self loops, NULLs and repeated edges change nothing. No neighbour list is gathered: each step is a partial
    aggregate and equi-joins, and every step's edges are written to the shared folder. Nodes without an edge to
    another node are not returned.
    """
    edges = saved(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_ok"))
        .where("_ok and a > b").select("a", "b").distinct(),
        "edges",
    )
    mark = _mark(edges)
    while mark[0]:
        edges = saved(_toward_minimum(_toward_minimum(edges, True), False), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
