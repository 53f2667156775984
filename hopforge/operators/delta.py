"""What changes from one part to the next in the visiting order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.functions.ordering import numbered
from hopforge.plans.lineage import cut


def steps(order: DataFrame) -> DataFrame:
    """(from_part, to_part): consecutive pairs, from the last back to the first."""
    # One row a part; the window has no partition because the order is one list.
    n = order.count()
    ahead = order.select(F.pmod(F.col("seq") - 1, F.lit(n)).alias("seq"), F.col("part").alias("to_part"))
    return order.select("seq", F.col("part").alias("from_part")).join(ahead, "seq").select("from_part", "to_part")


def same(ids: DataFrame, step: DataFrame) -> DataFrame:
    """(from_part, to_part, node, prev_pos, next_pos): nodes that both parts hold."""
    prev = ids.select(F.col("part").alias("from_part"), "node", F.col("lid").alias("prev_pos"))
    then = ids.select(F.col("part").alias("to_part"), "node", F.col("lid").alias("next_pos"))
    return prev.join(F.broadcast(step), "from_part").join(then, ["to_part", "node"]).select("from_part", "to_part", "node", "prev_pos", "next_pos")


def added(ids: DataFrame, step: DataFrame) -> DataFrame:
    """(from_part, to_part, node, next_pos): nodes to load."""
    then = ids.select(F.col("part").alias("to_part"), "node", F.col("lid").alias("next_pos")).join(F.broadcast(step), "to_part")
    prev = ids.select(F.col("part").alias("from_part"), "node")
    return then.join(prev, ["from_part", "node"], "left_anti").select("from_part", "to_part", "node", "next_pos")


def freed(ids: DataFrame, step: DataFrame) -> DataFrame:
    """(from_part, to_part, prev_pos): places of nodes that the next part doesn't hold."""
    prev = ids.select(F.col("part").alias("from_part"), "node", F.col("lid").alias("prev_pos")).join(F.broadcast(step), "from_part")
    then = ids.select(F.col("part").alias("to_part"), "node")
    return prev.join(then, ["to_part", "node"], "left_anti").select("from_part", "to_part", "prev_pos")


def padded(places: DataFrame, ids: DataFrame, step: DataFrame, side: str, pos: str) -> DataFrame:
    """places, and the places past the end of the ``side`` part up to the longest part's length."""
    sizes = ids.groupBy("part").agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    past = step.join(sizes.withColumnRenamed("part", side), side).where(F.col("n") < longest).select("from_part", "to_part", F.explode(F.sequence(F.col("n"), F.lit(longest - 1))).alias(pos))
    return places.select("from_part", "to_part", pos).unionByName(past)


def pairing(ids: DataFrame, step: DataFrame) -> DataFrame:
    """(from_part, to_part, k, prev_pos, next_pos): the k-th free place takes the k-th new one."""
    by = ["from_part", "to_part"]
    old = numbered(padded(freed(ids, step), ids, step, "from_part", "prev_pos"), by, ["prev_pos"], "k")
    new = numbered(padded(added(ids, step), ids, step, "to_part", "next_pos"), by, ["next_pos"], "k")
    return old.join(new, [*by, "k"]).select(*by, (F.col("k") - 1).alias("k"), "prev_pos", "next_pos")


def next_slots(slots: DataFrame, same_nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lid, slot) of the next part from (lid, slot) of this one.

    Kept nodes keep their slot; the k-th new place takes the slot of the k-th
    free one. same_nodes and pairs are those of one step.
    """
    moves = same_nodes.select("prev_pos", "next_pos").unionByName(pairs.select("prev_pos", "next_pos"))
    return moves.join(slots.withColumnRenamed("lid", "prev_pos"), "prev_pos").select(F.col("next_pos").alias("lid"), "slot")


def slot_cycle(ids: DataFrame, order: DataFrame) -> DataFrame:
    """(from_part, to_part, lid, slot): the slot maps after each step of one cycle of the visiting order.

    The first part's places are its slots. A map is as long as the longest
    part, and each step reads the one before it.
    """
    step = steps(order)
    moves = cut(same(ids, step).drop("node").unionByName(pairing(ids, step).drop("k")))
    slots, out = None, None
    for row in order.orderBy("seq").collect():  # one row a part
        here = moves.where(F.col("from_part") == row["part"])
        if slots is None:
            now = here.withColumn("slot", F.col("prev_pos"))
        else:
            now = here.join(slots, "prev_pos")
        now = cut(now.select("from_part", "to_part", F.col("next_pos").alias("lid"), "slot"))
        out = now if out is None else out.unionByName(now)
        slots = now.select(F.col("lid").alias("prev_pos"), "slot")
    return out


def carried(held: DataFrame | None, ids: DataFrame, features: DataFrame) -> DataFrame:
    """The feature rows of the nodes of ids: those in ``held`` are kept, and only the others are looked up in features."""
    wanted = ids.select("node").distinct()
    if held is None:
        return features.join(wanted, "node", "left_semi")
    fresh = wanted.join(held, "node", "left_anti")
    return held.join(wanted, "node", "left_semi").unionByName(features.join(fresh, "node", "left_semi").select(*held.columns))
