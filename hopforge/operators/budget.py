"""Memory budget and lossy trimming of a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopforge.functions.ordering import numbered, shuffled
from hopforge.plans.placement import HUB

#: Share of nodes kept by value, share of the others dropped, degree from which rows are cut, and share kept of those.
KEPT, DROPPED, HIGH, SHORT = 0.6, 0.8, 60, 0.5


def memory_bytes(edges: Column, nodes: Column, features: int) -> Column:
    """Bytes of a part: pointers and indices, features, labels."""
    return (edges + nodes + 1) * 4 + nodes * F.lit(features).cast("long") * 4 + nodes * 8


def over_budget(manifest: DataFrame, features: int, limit: float) -> DataFrame:
    """(part, bytes, trims)."""
    held = memory_bytes(F.col("n_edges"), F.col("n_nodes"), features)
    return manifest.select("part", held.alias("bytes"), (held > F.lit(limit)).alias("trims"))


def trim_nodes(ranked: DataFrame, seed: int = 42) -> DataFrame:
    """(part, node, kept): the first int(0.6 n) by value stay, and of the rest all but a random int(0.8 m).

    ranked is (part, node, value, rank).
    """
    # One row a part.
    sizes = F.broadcast(ranked.groupBy("part").agg(F.count("*").alias("n")).withColumn("first", F.floor(F.col("n") * F.lit(KEPT))))
    sized = ranked.select("part", "node", "rank").join(sizes, "part")
    top = sized.where(F.col("rank") <= F.col("first")).select("part", "node", F.lit(True).alias("kept"))
    rest = sized.where(F.col("rank") > F.col("first")).withColumn("digest", shuffled(F.lit(seed), "part", "node"))
    drops = F.floor((F.col("n") - F.col("first")) * F.lit(DROPPED))
    return top.unionByName(numbered(rest, ["part"], ["digest", "node"], "lot").select("part", "node", (F.col("lot") > drops).alias("kept")))


def trim_edges(edges: DataFrame, kept: DataFrame, seed: int = 42) -> DataFrame:
    """(part, src, dst): in-edges of dropped nodes go; rows of HIGH edges or more keep a random half.

    edges is (part, src, dst); kept is (part, node, kept) over the same ids.
    """
    alive = edges.join(kept.where("kept").select("part", F.col("node").alias("dst")), ["part", "dst"], "left_semi")
    row = ["part", "dst"]
    counts = alive.groupBy(*row).agg(F.count("*").alias("deg"))
    low = alive.join(counts.where(F.col("deg") < HIGH), row, "left_semi").select("part", "src", "dst")
    high = alive.join(counts.where(F.col("deg") >= HIGH), row).withColumn("digest", shuffled(F.lit(seed), "part", "dst", "src"))
    # A row of up to HUB edges is ranked by one task, and the few longer ones by ranges.
    short = high.where(F.col("deg") <= HUB).withColumn("lot", F.row_number().over(Window.partitionBy(*row).orderBy("digest", "src")))
    ranked = [short.select("part", "src", "dst", "deg", "lot")]
    if counts.where(F.col("deg") > HUB).take(1):
        ranked.append(numbered(high.where(F.col("deg") > HUB), row, ["digest", "src"], "lot").select("part", "src", "dst", "deg", "lot"))
    for some in ranked:
        low = low.unionByName(some.where(F.col("lot") <= F.floor(F.col("deg") * F.lit(SHORT))).select("part", "src", "dst"))
    return low


def kept_places(kept: DataFrame) -> DataFrame:
    """(part, node, place): running number of kept nodes by id, from 0; null for dropped ones."""
    places = numbered(kept.where("kept").select("part", "node"), ["part"], ["node"], "place")
    return places.select("part", "node", (F.col("place") - 1).alias("place")).unionByName(kept.where("not kept").select("part", "node", F.lit(None).cast("long").alias("place")))


def kept_features(places: DataFrame, features: DataFrame) -> DataFrame:
    """(part, place, node, feat) of kept nodes."""
    return places.where("place is not null").join(features, "node").select("part", "place", "node", "feat")
