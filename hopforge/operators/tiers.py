"""Two-tier slots: positive slots are in the fast tier, negative ones in the host tier, none is 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.functions.ordering import numbered


def tier_init(kept: DataFrame) -> DataFrame:
    """(part, node, slot) from (part, node, kept): kept nodes get 1, 2, ... and the others -1, -2, ..., by id."""
    k = F.col("k")
    return numbered(kept.select("part", "node", "kept"), ["part", "kept"], ["node"], "k").select("part", "node", F.when(F.col("kept"), k).otherwise(-k).alias("slot"))


def tier_write(rows: DataFrame, updates: DataFrame, by: Sequence[str] = ("slot",)) -> DataFrame:
    """(slot, value): rows with those of updates in their place; each slot's sign is its tier.

    With ``by`` of part and slot all parts are written at once.
    """
    return rows.join(updates.select(*by), list(by), "left_anti").unionByName(updates.select(*rows.columns))


def tier_swap(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """(part, node, slot): every wanted node in the fast tier.

    The i-th wanted node in the host tier and the i-th unwanted one in the
    fast tier change slots, by id; wanted nodes beyond the unwanted ones stay.
    """
    marked = slots.join(wanted.select("part", "node", F.lit(True).alias("w")), ["part", "node"], "left").withColumn("w", F.coalesce("w", F.lit(False)))
    up, down = (numbered(marked.where(which).select("part", "node", "slot"), ["part"], ["node"], "i") for which in ("w and slot < 0", "not w and slot > 0"))
    pairs = up.join(down.select("part", "i", F.col("node").alias("node2"), F.col("slot").alias("slot2")), ["part", "i"])
    both = F.array(F.struct(F.col("node"), F.col("slot2").alias("slot")), F.struct(F.col("node2").alias("node"), F.col("slot")))
    moved = pairs.select("part", F.inline(both))
    return slots.join(moved.select("part", "node"), ["part", "node"], "left_anti").select("part", "node", "slot").unionByName(moved)
