"""Example graphs made from the order tables.

Nodes are parts; an edge joins parts of one order whose lines follow each
other. ``sparse`` also asks for returned lines on both sides, ``mid`` on the
first, ``full`` takes any two lines of an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.plans.lineage import cut

#: One part in so many is a seed; seeds are dealt over PARTS parts.
EVERY, PARTS = 20, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str, kind: str = "sparse") -> DataFrame:
    """(src, dst), distinct, cut off from the join that made it."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("la"), F.col("l_returnflag").alias("fa"))
    b = lines.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("lb"), F.col("l_returnflag").alias("fb"))
    if kind in ("sparse", "mid"):
        a = a.where("fa = 'R'")
    if kind == "sparse":
        b = b.where("fb = 'R'")
    if kind == "full":
        met = a.join(b, "l_orderkey")
    else:
        met = a.withColumn("lb", F.col("la") + 1).join(b, ["l_orderkey", "lb"])
    return cut(met.where("src <> dst").select("src", "dst").distinct())


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def seeds(spark: SparkSession, sf_dir: str, parts: int = PARTS) -> DataFrame:
    """(node, part)."""
    return nodes(spark, sf_dir).where(F.col("node") % EVERY == 0).select("node", (F.expr(f"node div {EVERY}") % parts).alias("part"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, feat, label): nodes are dealt over all embeddings, whose ids are dense from 0."""
    rows = table(spark, sf_dir, "embeddings")
    return nodes(spark, sf_dir).join(rows, F.col("node") % max(1, rows.count()) == F.col("vec_id")).select("node", F.col("embedding").alias("feat"), F.col("label").cast("long").alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, x) with x of doubles."""
    return features(spark, sf_dir).select("node", F.col("feat").cast("array<double>").alias("x"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, split)."""
    d = F.col("node") % 10
    return nodes(spark, sf_dir).select("node", F.when(d < 6, "train").when(d < 8, "valid").otherwise("test").alias("split"))
