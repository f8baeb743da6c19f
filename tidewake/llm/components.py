"""Connected components of an edge table by alternating star contraction (public: Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import cut, discard


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b); a component is named by its smallest node.

    Loops, nulls and repeated edges have no effect. Each round sends every
    node's larger neighbours to its smallest one and links smaller neighbours
    likewise. Minima are combined before they are shuffled, and are written
    before they meet the edges: only a join of two plain exchanges can be split
    by adaptive execution, and so a hub of any degree is no single task's work.
    A round is written to the shared folder, which keeps the plan short and
    survives lost executors.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = cut(e, "edges"), None
    for _ in range(max_rounds):
        seen = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == last or not seen["n"]:
            break
        last = seen
        large = cut(_star(e, "x", _both(e), _larger), "edges")
        small = cut(_star(large, "u", large, _smaller), "edges")
        discard(e, large)
        e = small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _star(e: DataFrame, node: str, neighbours: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """One half of a round; the minima of ``neighbours`` are written, as the join would otherwise not be split at hubs."""
    value = next(c for c in neighbours.columns if c != node)
    least = cut(neighbours.groupBy(node).agg(F.min(value).alias("m")), "least")
    return step(e, least)


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))


def _larger(e: DataFrame, least: DataFrame) -> DataFrame:
    larger = e.select(F.col("v").alias("x"), F.col("u").alias("y"))
    return larger.join(least.select("x", F.least("x", "m").alias("m")), "x").where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _smaller(e: DataFrame, least: DataFrame) -> DataFrame:
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
