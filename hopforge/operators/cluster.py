"""Seed clustering: one round of label propagation among adjacent seeds, then labels dealt to parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.functions.ordering import global_rank, shuffled


def seed_labels(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, label): the smallest id among a seed and its adjacent seeds."""
    nodes = seeds.select("node")
    inner = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    near = inner.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))))
    least = near.groupBy("node").agg(F.min("other").alias("other"))
    return nodes.join(least, "node", "left").select("node", F.least("node", "other").alias("label"))


def label_histogram(labels: DataFrame) -> DataFrame:
    """(label, n) of the labels in use."""
    return labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 0")


def labels_by_size(histogram: DataFrame, most: int | None = None) -> DataFrame:
    """(label, n): labels by count, largest first, ties by label; all of them or the first ``most``."""
    ordered = histogram.orderBy(F.desc("n"), "label")
    return ordered if most is None else ordered.limit(most)


def assign_parts(labels: DataFrame, parts: int, seed: int = 42) -> DataFrame:
    """(node, label, part): labels in random order, cut into chunks of n div parts + 1."""
    names = labels.select("label").distinct().withColumn("digest", shuffled(F.lit(seed), "label"))
    ranked = global_rank(names, "digest", "label")
    n = ranked.count()
    dealt = ranked.select("label", F.floor((F.col("rank") - 1) / F.lit(n // parts + 1)).cast("long").alias("part"))
    return labels.join(dealt, "label").select("node", "label", "part")


