"""Whole jobs: partition a graph, sample its batches, score all nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.operators import cluster, delta, merge, networks, order, propagate, sampler, subgraph
from hopforge.plans.lineage import cut


@dataclass(frozen=True)
class Partitioned:
    """Everything a training job reads, by part."""

    members: DataFrame
    edges: DataFrame
    ids: DataFrame
    adjacency: DataFrame
    ranked: DataFrame
    manifest: DataFrame
    plan: DataFrame
    seeds: DataFrame


def partition(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, parts: int, ceiling: float = merge.CEILING, hops: int = 3) -> Partitioned:
    """Cluster seeds, spread labels and values, merge cheap parts, extract and order them.

    seeds is (node). hops must be at least the number of sampling hops, or
    samples near a part's rim are cut short.
    """
    edges = cut(edges.select("src", "dst").distinct())
    dealt = cut(cluster.assign_parts(cluster.seed_labels(edges, seeds), parts).select("node", "part"))
    members = propagate.membership(edges, dealt, hops)
    n_edges, n_nodes = edges.count(), nodes.count()
    plan = merge.merge_plan(members, n_edges / max(1, n_nodes), ceiling)
    joined = cut(merge.merged(members, plan, hops))
    home = dealt.join(plan.select("part", "merged_part"), "part").select("node", F.col("merged_part").alias("part"))
    kept = cut(subgraph.induced_edges(edges, joined.where("not is_boundary"), home))
    ids = subgraph.local_ids(joined)
    ranked = subgraph.ranked_by_value(joined, propagate.values(edges, nodes, seeds, hops))
    sizes = subgraph.manifest(joined, kept)
    path = order.visit_order(joined)
    return Partitioned(joined, kept, ids, subgraph.adjacency(subgraph.relabelled(kept, ids)), ranked, sizes.join(path.select("part", "seq"), "part"), plan, home)


def save(done: Partitioned, path: str) -> None:
    """Write a partitioned graph; tables of a part lie in a folder of their own."""
    for name in ("members", "edges", "ids", "adjacency", "ranked", "seeds"):
        getattr(done, name).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")
    done.manifest.write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, name: str, part: int | None = None) -> DataFrame:
    """A saved table, or one part of it: only that part's folder is read."""
    rows = spark.read.parquet(f"{path}/{name}").withColumn("part", F.col("part").cast("long"))
    return rows if part is None else rows.where(F.col("part") == part)


def schedule(manifest: DataFrame, epochs: int) -> DataFrame:
    """(step, epoch, part) from (part, seq): the same path in each epoch."""
    n = manifest.count()  # one row a part
    each = manifest.select("part", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))).alias("epoch"))
    return each.select((F.col("epoch") * n + F.col("seq")).alias("step"), "epoch", "part")


def batch_tables(done: Partitioned, fanouts: list[int], size: int, epoch: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batch rows, sampled edges, node mapping) of an epoch, sampled inside parts."""
    rows = cut(sampler.batches(done.seeds, size, epoch=epoch))
    # Parts hold whole neighbourhoods, so sampling their union is sampling inside each part.
    sampled = sampler.sample(done.edges.select("src", "dst").distinct(), rows, fanouts)
    return rows, sampled, sampler.remap(rows, sampled)


def train(done: Partitioned, features: DataFrame, net: networks.Network, fanouts: list[int], size: int, epochs: int = 1, group: int = 64, rate: float = 1e-3, decay: float = 5e-4, seed: int = 0) -> tuple[networks.Network, list[float]]:
    """(network, mean loss of each epoch): minibatch training along the schedule of the parts.

    features is (node, x, label) and covers all nodes. Each turn takes one
    part: it keeps the feature rows that the part before held, looks up the
    others, samples the part's batches and takes a step for each ``group`` of
    them, which is how many batches work at once; the sampled tables of a part
    are read once a group.
    """
    turns = schedule(done.manifest, epochs).orderBy("step").collect()  # one row a part and epoch
    adam, held, totals = networks.Adam(rate, decay), None, [[0.0, 0] for _ in range(epochs)]
    for turn in turns:
        here = F.col("part") == turn["part"]
        members = done.members.where(here)
        held = cut(delta.carried(held, members, features))
        rows = cut(sampler.batches(done.seeds.where(here), size, epoch=turn["epoch"]))
        drawn = sampler.sample(done.edges.where(here).select("src", "dst").distinct(), rows, fanouts)
        inputs = [cut(t) for t in networks.batch_inputs(rows, drawn, sampler.remap(rows, drawn), held)]
        n_batches = rows.select("batch").distinct().count()
        for first in range(0, n_batches, group):
            at = turn["part"] * sampler.PER_PART + first
            edges, nodes = (t.where(F.col("batch").between(at, at + group - 1)) for t in inputs)
            net, loss, n = networks.step(net, adam, edges, nodes, seed + turn["step"])
            totals[turn["epoch"]][0] += loss
            totals[turn["epoch"]][1] += n
    return net, [loss / max(1, n) for loss, n in totals]
