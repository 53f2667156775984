"""Reproducible random order, and ranks and running sums that no one task works out alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopforge.plans.lineage import cut


def shuffled(*keys: Column | str) -> Column:
    """A random but repeatable sort key: MD5 of the keys joined by |."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]).cast("binary"))


def draw(limit: Column | int, *keys: Column | str) -> Column:
    """A repeatable number in 0..limit-1 from the keys."""
    number = F.conv(F.substring(shuffled(*keys), 1, 8), 16, 10).cast("long")
    return F.pmod(number, F.lit(limit) if isinstance(limit, int) else limit)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rank: str = "rank", value: str | None = None, upto: str = "upto") -> DataFrame:
    """df with the 1-based rank of each row among those of equal keys, and the running sum of ``value`` if one is named.

    Rows are dealt by ranges of (keys, order), so a key with most of the rows
    is spread over many tasks. Rows are numbered inside each range; what lies
    before a range under the same key is added. The counts by range and key
    reach the driver: one for each range, and one more for each key. So keys
    must be few (parts, tiers, steps). order must tell rows apart.
    """
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut(df.repartitionByRange(*by).withColumn("range_", F.spark_partition_id()))
    amount = F.sum(value) if value else F.lit(0)
    totals = ranged.groupBy(*keys, "range_").agg(F.count("*").alias("n_"), amount.cast("long").alias("s_"))
    before, held = [], {}
    for row in sorted(totals.collect(), key=lambda r: r["range_"]):
        key = tuple(row[k] for k in keys)
        n, s = held.get(key, (0, 0))
        before.append((*key, row["range_"], n, s))
        held[key] = (n + row["n_"], s + (row["s_"] or 0))
    schema = totals.schema
    starts = df.sparkSession.createDataFrame(before, schema)
    within = Window.partitionBy(*keys, "range_").orderBy(*by[len(keys) :])
    out = ranged.withColumn(rank, F.row_number().over(within).cast("long"))
    if value:
        out = out.withColumn(upto, F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(starts), [*keys, "range_"]).withColumn(rank, F.col(rank) + F.col("n_"))
    if value:
        out = out.withColumn(upto, F.col(upto) + F.col("s_"))
    return out.drop("range_", "n_", "s_")


def global_rank(df: DataFrame, digest: str, *ties: str, rank: str = "rank") -> DataFrame:
    """df with the 1-based rank by (digest, ties) over all rows."""
    return numbered(df, [], [digest, *ties], rank)
