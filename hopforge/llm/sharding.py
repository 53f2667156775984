"""Sharding by sampled splitters.

A size-weighted sample of the sort keys gives splitters for many fine ranges
of about equal bytes. A range that holds more records than one task should
sort is subdivided by splitters sampled inside it, so ranges grow in number
with the input and not in size. Exact byte and row counts of the ranges give
the shard boundaries, and running sums inside a range find the exact record.
Sampling decides only how the work is dealt, never the result: the shards are
the exact size-weighted quantiles of the key order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopforge.llm.support import cut, table

#: Coarse ranges, fine ranges in each, sampled keys per range, and records of a range from which it is subdivided.
COARSE, FINE, OVERSAMPLE, RANGE_ROWS = 32, 32, 8, 1 << 18


def _nested(literal: object, kind: str) -> Column:
    """A constant array from driver values; folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(literal)), kind)


def _below(splitters: Column, key: Column) -> Column:
    return F.size(F.filter(splitters, lambda s: s <= key))


def assign_shards(rows: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0) to rows.

    key: a string column that orders the rows; size: a long column, >= 0.
    Shards are consecutive in key order and as near to equal size as whole
    records allow: a record belongs to the shard that holds its middle byte.
    Rows of equal key are dealt in any order; an empty input gives no rows; a
    null key sorts as the empty string, a null size counts as 0. A key that
    holds a third of all bytes is cut like any other range only if the key
    tells its records apart, so end the key with a unique part. All other
    columns are kept as they are, whatever they are called, except shard and
    slot (in any case), which are replaced.

    The driver holds, and executors are sent, OVERSAMPLE sampled keys and one
    row for each RANGE_ROWS records or less, and some 10^4 keys besides.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    # The working columns are structs, so that no name can clash.
    held = cut(rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(key), F.lit("")).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("z")))
    total, n = held.agg(F.coalesce(F.sum("z"), F.lit(0)), F.count("*")).first()
    kept = [F.col("row")[c].alias(c) for c in names]
    if not n:
        return held.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # About COARSE * FINE * OVERSAMPLE keys, however large the input is.
    rate = COARSE * FINE * OVERSAMPLE / max(total, 1)
    lot = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 40))
    sample = sorted(r[0] for r in held.where(lot < F.col("z") * F.lit(rate * (1 << 40))).select("k").distinct().collect())
    step = max(1, len(sample) // (COARSE * FINE))
    fine = sorted(set(sample[step::step]))
    blocks = [fine[i : i + FINE] for i in range(0, len(fine), FINE)] or [[""]]
    coarse = _nested([b[0] for b in blocks], "array<string>")
    inner = _nested([[], *blocks], "array<array<string>>")
    ranged = held.withColumn("c", _below(coarse, F.col("k"))).withColumn("r", F.col("c") * (FINE + 1) + _below(inner[F.col("c")], F.col("k"))).drop("c")
    ranged = _subdivided(ranged, dict(ranged.groupBy("r").count().collect()))
    # One row a range.
    counts = sorted(ranged.groupBy("r", "part").agg(F.sum("z"), F.count("*")).collect())
    before, at, past = [], 0, 0
    for r, part, z, rows_in in counts:
        before.append((r, part, at, past))
        at, past = at + z, past + rows_in
    starts = spark.createDataFrame(before, "r int, part int, z0 long, n0 long")
    within = Window.partitionBy("r", "part").orderBy("k")
    numbered = ranged.withColumn("rank", F.row_number().over(within) - 1).withColumn("upto", F.sum("z").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(starts), ["r", "part"])
    middle = 2 * (F.col("upto") + F.col("z0")) - F.col("z")
    numbered = cut(numbered.select("row", (F.col("rank") + F.col("n0")).alias("rank"), F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(total, 1)))).cast("int").alias("shard")))
    first = dict(numbered.groupBy("shard").agg(F.min("rank")).collect())  # one row a shard
    starts = _nested([first.get(s, 0) for s in range(shards)], "array<bigint>")
    return numbered.select(*kept, "shard", (F.col("rank") - starts[F.col("shard")]).alias("slot"))


def _subdivided(ranged: DataFrame, counts: dict[int, int]) -> DataFrame:
    """ranged with ``part``, the place of k among splitters sampled inside each overfull range; 0 in others."""
    overfull = {r: n for r, n in counts.items() if n > RANGE_ROWS}
    if not overfull:
        return ranged.withColumn("part", F.lit(0))
    rate = OVERSAMPLE / RANGE_ROWS
    lot = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 40))
    drawn: dict[int, list[str]] = {r: [] for r in overfull}
    for r, k in ranged.where(F.col("r").isin(*overfull) & (lot < F.lit(int(rate * (1 << 40))))).select("r", "k").distinct().collect():
        drawn[r].append(k)
    rows = []
    for r, keys in drawn.items():
        keys.sort()
        step = max(1, len(keys) * RANGE_ROWS // overfull[r])
        rows.append((r, sorted(set(keys[step::step]))))
    splitters = ranged.sparkSession.createDataFrame(rows, "r int, within array<string>")
    found = ranged.join(F.broadcast(splitters), "r", "left")
    return found.withColumn("part", F.when(F.col("within").isNull(), 0).otherwise(_below(F.col("within"), F.col("k")))).drop("within")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deal documents into shards of near-equal UTF-8 bytes, equal texts side by side.

    The key is the text's MD5 and then doc_id, so copies stay together but for
    a boundary that falls among them, and a group of copies of any size is
    dealt over as many shards as its bytes need. A null text has no bytes;
    every document counts one byte more than its text. Repeated rows get a
    slot each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    keyed = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.concat(F.md5(F.encode(text, "utf-8")), F.coalesce(doc, F.lit(""))).alias("key"))
    return assign_shards(keyed, "key", "size", shards).drop("key")


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP7_SQL = """
WITH byte AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs
  FROM range(256) t(i)
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
         md5(coalesce(text, '')) || printf('%016x', xor(doc_id::HUGEINT, 9223372036854775808::HUGEINT)) AS key
  FROM documents
), sums AS (
  SELECT *, sum(size) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d
), dealt AS (
  SELECT *, least(15, (2 * upto - size) * 16 // (2 * total))::INT AS shard FROM sums
)
SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
                       lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, NULL::INT AS grown_shard
FROM dealt, byte
"""
