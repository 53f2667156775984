"""Extraction of parts: kept edges, local ids, adjacency by destination, gathers and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.functions.ordering import numbered


def self_loops(seeds: DataFrame) -> DataFrame:
    """(part, src, dst): a loop at each seed, so that every seed has an in-edge."""
    return seeds.select("part", F.col("node").alias("src"), F.col("node").alias("dst"))


def induced_edges(edges: DataFrame, interior: DataFrame, seeds: DataFrame) -> DataFrame:
    """(part, src, dst): edges into a part's interior nodes, and the seeds' loops.

    Interior nodes keep all in-neighbours and these are members by
    construction, so one join on dst is enough. ``interior`` is (part, node).
    """
    kept = edges.join(interior.select("part", F.col("node").alias("dst")), "dst").select("part", "src", "dst")
    return kept.unionByName(self_loops(seeds))


def closure_violations(edges: DataFrame, members: DataFrame, interior: DataFrame) -> DataFrame:
    """(part, src, dst): edges into an interior node whose source the part doesn't hold; none if all is well."""
    into = edges.join(interior.select("part", F.col("node").alias("dst")), "dst")
    return into.join(members.select("part", F.col("node").alias("src")), ["part", "src"], "left_anti").select("part", "src", "dst")


def local_ids(members: DataFrame) -> DataFrame:
    """(part, node, lid): places in the part's sorted node list, from 0."""
    return numbered(members.select("part", "node"), ["part"], ["node"], "lid").select("part", "node", (F.col("lid") - 1).alias("lid"))


def relabelled(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(part, src, dst) with local ids."""
    of = lambda end: ids.select("part", F.col("node").alias(end), F.col("lid").alias(f"{end}_lid"))
    return edges.join(of("src"), ["part", "src"]).join(of("dst"), ["part", "dst"]).select("part", F.col("src_lid").alias("src"), F.col("dst_lid").alias("dst"))


def indptr(local_edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(part, dst, deg, upto): in-degree and its running sum; nodes without in-edges are there too."""
    counts = local_edges.groupBy("part", "dst").agg(F.count("*").alias("deg"))
    rows = ids.select("part", F.col("lid").alias("dst")).join(counts, ["part", "dst"], "left").withColumn("deg", F.coalesce("deg", F.lit(0)).cast("long"))
    return numbered(rows, ["part"], ["dst"], value="deg").select("part", "dst", "deg", "upto")


def degrees_from_indptr(pointers: DataFrame) -> DataFrame:
    """(part, dst, deg): differences of neighbouring pointers; dst are local ids, one after the other."""
    before = pointers.select("part", (F.col("dst") + 1).alias("dst"), F.col("upto").alias("before"))
    return pointers.join(before, ["part", "dst"], "left").select("part", "dst", (F.col("upto") - F.coalesce("before", F.lit(0))).alias("deg"))


def adjacency(local_edges: DataFrame) -> DataFrame:
    """(part, dst, nbrs): sorted in-neighbours of each node that has some."""
    return local_edges.groupBy("part", "dst").agg(F.sort_array(F.collect_list("src")).alias("nbrs"))


def indices(local_edges: DataFrame) -> DataFrame:
    """(part, pos, dst, src): the flat index vector of a part, by destination and then source."""
    return numbered(local_edges, ["part"], ["dst", "src"], "pos").select("part", (F.col("pos") - 1).alias("pos"), "dst", "src")


def gathered(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of a table keyed by node, in a part's local order."""
    return ids.join(table, "node")


def ranked_by_value(members: DataFrame, value: DataFrame) -> DataFrame:
    """(part, node, value, rank): nodes by value, largest first, ties by id."""
    valued = members.select("part", "node").join(value, "node").select("part", "node", "value")
    return numbered(valued, ["part"], [F.desc("value"), "node"])


def ranked_local(ranked: DataFrame, ids: DataFrame) -> DataFrame:
    """(part, rank, lid): the local ids of a part's nodes in the order of ranked_by_value."""
    return ranked.join(ids, ["part", "node"]).select("part", "rank", "lid")


def manifest(members: DataFrame, kept: DataFrame) -> DataFrame:
    """(part, n_nodes, n_edges)."""
    rows = members.select("part", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(kept.select("part", F.lit(0).alias("n"), F.lit(1).alias("e")))
    return rows.groupBy("part").agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"))
