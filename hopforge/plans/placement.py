"""Edges placed once by the key that every round of an iteration joins on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.plans.lineage import cut

#: Edges at one node from which they are kept apart, so that no task gets them all.
HUB = 1_000_000


def placed(df: DataFrame, key: str) -> DataFrame:
    """df hash-partitioned and sorted by key, in the checkpoint folder.

    Later joins and aggregates on key neither shuffle nor sort it. The number
    of partitions is fixed here, because adaptive planning would not let the
    checkpoint know how its rows lie.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    n = int(conf.get("spark.sql.shuffle.partitions"))
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(n, key).sortWithinPartitions(key))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


@dataclass(frozen=True)
class Placed:
    """Edges by one end. ``heavy`` holds those of hubs, of which there is one in HUB edges at most."""

    key: str
    light: DataFrame
    heavy: DataFrame | None
    hubs: DataFrame | None

    def meet(self, rows: DataFrame, few: bool = True) -> DataFrame:
        """Edges joined with rows on the key. ``few``: rows has at most a few per key, one a part, say."""
        out = self.light.join(rows, self.key)
        if self.heavy is None or self.hubs is None:
            return out
        # If the rows of hubs are few, they go to the hubs' edges and not the other way round;
        # else both sides are dealt anew, and adaptive planning splits what is too large.
        at_hubs = rows.join(F.broadcast(self.hubs), self.key, "left_semi")
        return out.unionByName(self.heavy.join(F.broadcast(at_hubs) if few else at_hubs, self.key))


def place(edges: DataFrame, key: str, hub: int = HUB) -> Placed:
    hubs = edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hub).select(key)
    if not hubs.count():
        return Placed(key, placed(edges, key), None, None)
    hubs = cut(hubs)
    heavy = cut(edges.join(F.broadcast(hubs), key, "left_semi"))
    return Placed(key, placed(edges.join(F.broadcast(hubs), key, "left_anti"), key), heavy, hubs)
