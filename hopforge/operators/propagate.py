"""k-hop labelled reachability and integer value propagation, against the edges' direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.operators.degrees import in_degree
from hopforge.plans.lineage import cut
from hopforge.plans.placement import place

#: Value of a seed before the first round.
SEED_VALUE = 100_000


def membership(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(part, node, hop): the first hop at which each part's seeds reach a node.

    In-neighbours inherit the parts of a node. Edges are placed by destination
    once; each hop joins only what the hop before has added, and its result is
    cut off, so the plan doesn't grow with the number of hops.
    """
    graph = place(edges, "dst")
    reached = seeds.select("part", "node").distinct().withColumn("hop", F.lit(0).cast("long"))
    frontier = reached
    for hop in range(1, hops + 1):
        new = graph.meet(frontier.select("part", F.col("node").alias("dst"))).select("part", F.col("src").alias("node")).distinct()
        new = new.join(reached.select("part", "node"), ["part", "node"], "left_anti")
        frontier = cut(new.withColumn("hop", F.lit(hop).cast("long")))
        reached = reached.unionByName(frontier)
    return reached


def bitmask(members: DataFrame) -> DataFrame:
    """(node, mask): bit p is set if part p holds the node; for up to 63 parts."""
    return members.groupBy("node").agg(F.expr("bit_or(shiftleft(1L, cast(part as int)))").alias("mask"))


def boundary(members: DataFrame, hops: int = 3) -> DataFrame:
    """Members reached at the last hop only."""
    return members.where(F.col("hop") == hops).select("part", "node")


def values(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, value): each round a node gains value div in-degree of all it points to.

    All terms of a round read the round before. The in-degree is looked up
    and the edges are placed by destination once; a round is one join, which
    moves values only, and one sum on src.
    """
    start = seeds.select("node").distinct().withColumn("value", F.lit(SEED_VALUE).cast("long"))
    now = nodes.join(start, "node", "left").select("node", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    fed = place(edges.join(in_degree(edges).withColumnRenamed("node", "dst"), "dst"), "dst")
    for _ in range(rounds):
        # Only nodes with a value have something to hand on.
        handed = fed.meet(now.where("value > 0").withColumnRenamed("node", "dst")).groupBy(F.col("src").alias("node")).agg(F.sum(F.expr("value div indeg")).alias("gain"))
        now = cut(now.join(handed, "node", "left").select("node", (F.col("value") + F.coalesce("gain", F.lit(0))).alias("value")))
    return now
