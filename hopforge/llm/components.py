"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.llm.support import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each linked node.

    links has two long columns a and b; loops and repeats do no harm. Large
    stars and small stars take turns until nothing moves: each node hands its
    larger neighbours, then its smaller ones, to its smallest neighbour. Every
    step is one aggregate and one join on a node, and the number of steps
    grows with the logarithm of the longest chain. Nothing but two numbers a
    round reaches the driver. A node with very many links costs rows, not
    memory.
    """
    pairs = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = cut(pairs(links))
    mark = _mark(now)
    while True:
        # Large star: larger neighbours go to the smallest of the node and its neighbours.
        both = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = pairs(large)
        # Small star: smaller neighbours, and the node, go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = cut(pairs(moved))
        if (new := _mark(now)) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
