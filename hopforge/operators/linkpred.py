"""Link-prediction splits: sampled edges, negatives drawn evenly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.functions.ordering import draw, global_rank, shuffled

#: Shares of the sampled edges, in order. Fixed values.
TRAIN, TEST = 0.3, 0.6


def lp_split(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """(split, src, dst): the first int(n * share) edges in random order; 30 % train, 60 % test, the rest valid."""
    ranked = global_rank(edges.select("src", "dst", shuffled(F.lit(seed), "src", "dst").alias("digest")), "digest", "src", "dst")
    k = int(ranked.count() * share)
    train, test = int(k * TRAIN), int(k * TRAIN) + int(k * TEST)
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= test, "test").otherwise("valid")
    return ranked.where(F.col("rank") <= k).select(split.alias("split"), "src", "dst")


def lp_negatives(split: DataFrame, n_nodes: int, per_edge: int, seed: int = 42) -> DataFrame:
    """(split, src, dst, k, neg_dst): one negative per training edge, per_edge for the others."""
    wanted = F.when(F.col("split") == "train", 1).otherwise(per_edge)
    each = split.select("*", F.explode(F.sequence(F.lit(1).cast("long"), wanted.cast("long"))).alias("k"))
    return each.withColumn("neg_dst", draw(n_nodes, F.lit(seed), "src", "dst", "k"))


def split_rows(negatives: DataFrame) -> DataFrame:
    """(split, source_node, target_node, target_node_neg): a row an edge, its negatives in the order of k."""
    held = F.sort_array(F.collect_list(F.struct("k", "neg_dst")))
    rows = negatives.groupBy("split", F.col("src").alias("source_node"), F.col("dst").alias("target_node")).agg(held.alias("drawn"))
    return rows.select("split", "source_node", "target_node", F.col("drawn.neg_dst").alias("target_node_neg"))


def write_splits(rows: DataFrame, path: str) -> None:
    """Write the table of split_rows, a folder a split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A written table of splits, or one split of it: only that folder is read."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)
