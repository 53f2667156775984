"""Batches, fan-out sampling, relabelling, blocks and feature gathers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopforge.functions.ordering import numbered, shuffled
from hopforge.plans.lineage import cut
from hopforge.plans.placement import Placed, place

#: A batch's number is its part's number times this, plus its number in the part.
PER_PART = 1 << 20


def batches(seeds: DataFrame, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(batch, part, pos, node): a part's seeds in random order, ``size`` to a batch, the last one shorter."""
    drawn = seeds.select("part", "node", shuffled(F.lit(seed), F.lit(epoch), "node").alias("digest"))
    placed = numbered(drawn, ["part"], ["digest", "node"], "at").select("part", "node", (F.col("at") - 1).alias("at"))
    return placed.select((F.col("part") * PER_PART + F.floor(F.col("at") / size)).cast("long").alias("batch"), "part", (F.col("at") % size).cast("long").alias("pos"), "node")


def sample_hop(edges: DataFrame | Placed, frontier: DataFrame, hop: int, fanout: int, seed: int = 42) -> DataFrame:
    """(batch, hop, occ, k, src, dst): up to ``fanout`` in-neighbours of each occurrence in the frontier.

    frontier is (batch, occ, node). A negative fanout takes all. A node that
    occurs twice is expanded twice. Ranks over ``fanout`` are dropped before
    rows are shuffled to their occurrence.
    """
    ends = frontier.withColumnRenamed("node", "dst")
    met = edges.meet(ends, few=False) if isinstance(edges, Placed) else edges.join(ends, "dst")
    lot = shuffled(F.lit(seed), "batch", F.lit(hop), "occ", "src")
    k = F.row_number().over(Window.partitionBy("batch", "occ").orderBy(lot, "src"))
    drawn = met.select("batch", F.lit(hop).cast("long").alias("hop"), "occ", k.alias("k"), "src", "dst")
    if fanout >= 0:
        drawn = drawn.where(F.col("k") <= fanout)
    return drawn.withColumn("k", F.col("k").cast("long"))


def sample(edges: DataFrame, batch_rows: DataFrame, fanouts: Sequence[int], seed: int = 42, fast: DataFrame | None = None, dedup: bool = False) -> DataFrame:
    """(batch, hop, occ, k, src, dst) of all hops.

    The next frontier is the drawn sources, repeats kept (unless dedup), in
    the order of (occ, k); seeds aren't added again. For several hops the
    edges are placed by destination once. ``fast`` is an optional
    (node) table: with it only those nodes can be drawn as sources.
    """
    if fast is not None:
        edges = edges.join(fast.select(F.col("node").alias("src")), "src", "left_semi")
    graph = place(edges, "dst") if len(fanouts) > 1 else edges
    frontier, out = batch_rows.select("batch", F.col("pos").alias("occ"), "node"), None
    for hop, fanout in enumerate(fanouts, 1):
        drawn = cut(sample_hop(graph, frontier, hop, fanout, seed))
        out = drawn if out is None else out.unionByName(drawn)
        if dedup:
            drawn = drawn.groupBy("batch", "src").agg(F.min_by("occ", F.struct("occ", "k")).alias("occ"), F.min_by("k", F.struct("occ", "k")).alias("k"))
        occ = F.row_number().over(Window.partitionBy("batch").orderBy("occ", "k")) - 1
        frontier = drawn.select("batch", occ.cast("long").alias("occ"), F.col("src").alias("node"))
    return out


def remap(batch_rows: DataFrame, sampled: DataFrame) -> DataFrame:
    """(batch, lid, node): nodes by first occurrence in the seeds, then each hop's draws."""
    seen = batch_rows.select("batch", "node", F.struct(F.lit(0).cast("long").alias("hop"), F.col("pos").alias("occ"), F.lit(0).cast("long").alias("k")).alias("at"))
    drawn = sampled.select("batch", F.col("src").alias("node"), F.struct("hop", "occ", "k").alias("at"))
    first = seen.unionByName(drawn).groupBy("batch", "node").agg(F.min("at").alias("at"))
    lid = F.row_number().over(Window.partitionBy("batch").orderBy("at")) - 1
    return first.select("batch", lid.cast("long").alias("lid"), "node")


def blocks(sampled: DataFrame, mapping: DataFrame, depth: int) -> DataFrame:
    """(batch, depth, hop, occ, k, src_lid, dst_lid): the block of depth l holds the edges of hops 1 to l."""
    of = lambda end: mapping.select("batch", F.col("node").alias(end), F.col("lid").alias(f"{end}_lid"))
    local = sampled.join(of("src"), ["batch", "src"]).join(of("dst"), ["batch", "dst"])
    return local.select("batch", F.explode(F.sequence(F.col("hop"), F.lit(depth).cast("long"))).alias("depth"), "hop", "occ", "k", "src_lid", "dst_lid")


def batch_features(mapping: DataFrame, features: DataFrame) -> DataFrame:
    """(batch, lid, node, feat)."""
    return mapping.join(features, "node").select("batch", "lid", "node", "feat")


def gather_by_slot(mapping: DataFrame, slots: DataFrame, store: DataFrame) -> DataFrame:
    """(batch, lid, value): local id to slot, slot to row."""
    return mapping.join(slots, "node").join(store, "slot").select("batch", "lid", "value")
