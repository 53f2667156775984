"""Degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("indeg"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outdeg"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, indeg, outdeg) of all nodes; 0 for those without edges.

    One pass: each edge adds one at both ends, summed before the shuffle.
    """
    ends = F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    found = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("i", F.lit(0)).cast("long").alias("indeg"), F.coalesce("o", F.lit(0)).cast("long").alias("outdeg"))


def average_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, avg_degree."""
    counted = edges.select(F.lit(1).alias("e"), F.lit(0).alias("n")).unionByName(nodes.select(F.lit(0).alias("e"), F.lit(1).alias("n")))
    return counted.agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges")).withColumn("avg_degree", F.round(F.col("n_edges") / F.col("n_nodes"), 6))
