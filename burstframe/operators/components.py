"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    if large:
        linked = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        linked = both.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return linked.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` is connected with.

    Each round is written to the shared folder, so lineage stays short and a lost executor
    costs no more than its own tasks. Nulls are no nodes; loops give a component of one node.
    """
    typed = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # The edges are worked out once; loops are told from the rest in what is written.
    every = cut(typed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    current = every.where("a <> b")
    nodes = current if current.isEmpty() else None
    sign = None
    for _ in range(rounds):
        if nodes is not None:
            break
        current = cut(_star(_star(current, True), False))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        if rounds and nodes is None:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    single = every.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    known = members.unionByName(roots)
    return known.unionByName(single.join(known.select("node"), "node", "left_anti"))
