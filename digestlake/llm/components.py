"""Connected components of an edge table by alternating stars.

Each round turns the edges into stars around smaller and smaller centres: large-star moves every larger neighbour of
a node to the smallest node of its neighbourhood, small-star does so for the smaller ones. Rounds grow with the
logarithm of the longest chain. The minimum of a neighbourhood is a partial aggregate, and the join back to the edges
is one that adaptive execution splits, so a centre with very many leaves does not land in one task. Each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.llm.common import written


def _hook(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    both = edges.select("u", "v")
    if larger:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    joined = both.join(least, both["u"] == least["c"])
    moved = joined.where(F.col("v") > F.col("u")) if larger else joined
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (u, v), longs. component is the smallest node reachable.

    Loops and repeated edges are allowed, nulls are dropped, and an empty table gives an empty result. Nodes without
    an edge are not in the result.
    """
    now = edges.where("u is not null and v is not null and u != v")
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = _print(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = written(_hook(_hook(now, larger=True), larger=False), "cc")
        then, seen = seen, _print(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    centres = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        centres.select("node", F.col("node").alias("component"))
    )
