"""Substring dedup behind a count-min prefilter.

A window is a run of words. Its sketch key is the smallest hash of the short
word runs inside it, so equal windows have equal keys and neighbours mostly
share one: a document counts few keys, and a key's count is never below the
number of documents that hold a window under it. Documents are dealt into
blocks. Each block counts its documents' keys in a count-min sketch, of which
it sends the cells that aren't zero. The sketch is as wide as the input asks
for and lies in shards: all cells of a key are in one shard, which adds up the
blocks' cells and tells each block which of its own cells were counted twice
or more. In the second pass only windows whose key is estimated repeated are
grouped, by their own 96-bit hash. An estimate too high costs rows there; none
is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.llm.support import fresh, groups_of, mixed, table, texts, without

#: Rows of the sketch, and text bytes per cell of a row. Prose has a key in 140 bytes, so a row has some nine cells a key.
DEPTH, CELL_BYTES = 3, 16
#: Text bytes per block, per shard of the sketch and per shard of the windows.
BLOCK_BYTES, SKETCH_BYTES, SHARD_BYTES = 2 << 20, 64 << 20, 8 << 20
#: Cells of a row in one shard of the sketch.
WIDTH = SKETCH_BYTES // CELL_BYTES
#: Odd multipliers of the rolling hashes. Fixed values.
ROLL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = -(1 << 63)


def rolled(w: np.ndarray, factor: int, n: int) -> np.ndarray:
    """A polynomial hash of each n consecutive words, by doubling."""
    if len(w) < n:
        return w[:0]
    out, done, block, size, power = None, 0, w, 1, factor
    while True:
        if n & size:
            if out is None:
                out = block
            else:
                length = len(w) - done - size + 1
                out = out[:length] * np.uint64(power) + block[done : done + length]
            done += size
        if done == n:
            return out[: len(w) - n + 1]
        block = block[:-size] * np.uint64(power) + block[size:]
        size, power = 2 * size, power * power & 0xFFFFFFFFFFFFFFFF


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - n + size], x[n - size :]) if n > size else x


class Windows:
    """All windows of some texts, one after the other: start (among all words) and row of each."""

    def __init__(self, column: pa.Array, n: int):
        self.words = [(t or b"").split() for t in texts(column)]
        lengths = np.array([len(x) for x in self.words], np.int64)
        self.ends = np.cumsum(lengths)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for held in self.words for x in held), np.uint64, int(lengths.sum()))
        of = np.repeat(np.arange(len(lengths)), lengths)
        self.n = n
        self.start = np.flatnonzero(of[: max(0, len(of) - n + 1)] == of[n - 1 :])
        self.row = of[self.start]

    def first(self) -> np.ndarray:
        return rolled(self.hashes, ROLL[0], self.n)[self.start]

    def second(self) -> np.ndarray:
        """32 more bits: 96 tell 10^13 windows apart but for a chance of one in a thousand."""
        return (rolled(mixed(self.hashes), ROLL[1], self.n) >> np.uint64(32))[self.start]

    def keys(self, gram: int) -> np.ndarray:
        runs = mixed(rolled(self.hashes, ROLL[0], gram), 2)
        return sliding_min(runs, self.n - gram + 1)[self.start] if len(self.start) else runs[:0]


def cells(keys: np.ndarray, shards: int, width: int) -> np.ndarray:
    """(DEPTH, keys): a number for each cell of a key, the shard in its upper half."""
    shard = mixed(keys, 9) % np.uint64(shards) << np.uint64(32)
    return np.stack([shard | (mixed(keys, 10 + r) % np.uint64(width) + np.uint64(r * width)) for r in range(DEPTH)])


def block_sketch(row: np.ndarray, keys: np.ndarray, shards: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that the rows of a block count, ascending, and whether each is counted twice or more.

    A row counts a key once.
    """
    order = np.lexsort((row, keys))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    distinct, times = np.unique(k[new], return_counts=True)
    at, back = np.unique(cells(distinct, shards, width), return_inverse=True)
    total = np.bincount(back.ravel(), np.tile(times, DEPTH), len(at))
    return at, total > 1


def by_shard(at: np.ndarray):
    """(shard, from, to) of the runs of one shard in ascending cells."""
    shard = (at >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(shard)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
        if hi > lo:
            yield int(shard[lo]), lo, hi


def merged_cells(parts: list[bytes]) -> list[bytes]:
    """What a shard answers each block: a bit for each cell sent, one if the sum of all blocks is two or more.

    A part holds 32-bit numbers: a cell times two, and one more if its block
    has counted it twice or more.
    """
    sent = [np.frombuffer(x, "<u4") for x in parts]
    every = np.concatenate(sent)
    _, back = np.unique(every >> 1, return_inverse=True)
    often = (np.bincount(back, 1 + (every & 1)) > 1)[back]
    ends = np.cumsum([len(x) for x in sent])
    return [np.packbits(often[e - len(x) : e], bitorder="little").tobytes() for x, e in zip(sent, ends.tolist(), strict=True)]


def estimated_repeated(keys: np.ndarray, at: np.ndarray, often: np.ndarray, shards: int, width: int) -> np.ndarray:
    """Whether all cells of each key are among the often counted ones of the ascending cells ``at``."""
    return often[np.searchsorted(at, cells(keys, shards, width))].all(0)


def bounds_of_equals(a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each ordered entry, smallest least, largest most of each group) of equal (a, b)."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    starts = np.flatnonzero(new)
    if not len(a):
        return order, order, least, most
    return order, np.cumsum(new) - 1, np.minimum.reduceat(least[order], starts), np.maximum.reduceat(most[order], starts)


def remove_repeated_windows(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """docs with repeated passages gone, plus n_words and n_removed.

    docs has doc_id (long) and text (string). Words are runs without ASCII
    blanks, unchanged. A word goes if a window of ``window`` consecutive words
    covers it whose word sequence also starts in a document of smaller doc_id;
    windows are judged on the input. text becomes the kept words, joined by
    one space.

    A null or empty text has no words and gives an empty text. Rows of equal
    doc_id never count against each other; a null doc_id comes before all
    others. An empty table gives an empty table. Other columns stay; n_words
    and n_removed are replaced. Texts of any length are read whole. Rows are
    dealt by id and text, so that those of one id, or of none, don't meet in
    one block.
    """
    docs = without(docs, "n_words", "n_removed")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards, sketches, width = (size // per + 1 for per in (BLOCK_BYTES, SHARD_BYTES, SKETCH_BYTES, CELL_BYTES))
    width = min(WIDTH, width)  # of a shard; from one shard on, shards are added
    block = fresh(docs.columns, "block")
    dealt = docs.withColumn(block, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def count(group: pa.Table) -> pa.Table:
        held = Windows(group["text"], window)
        at, twice = block_sketch(held.row, held.keys(gram), sketches, width)
        packed = ((at & np.uint64(0xFFFFFFFF)) << np.uint64(1) | twice).astype("<u4")
        rows = [(s, packed[lo:hi].tobytes()) for s, lo, hi in by_shard(at)]
        where = pa.array([group[block][0].as_py()] * len(rows), pa.int64())
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "block": where, "cells": pa.array([r[1] for r in rows], pa.binary())})

    def merge(batches):
        for number, run in groups_of(batches, 0):
            bits = merged_cells(run["cells"].to_pylist())
            yield pa.RecordBatch.from_arrays([run["block"].combine_chunks(), pa.array([number] * len(bits), pa.int64()), pa.array(bits, pa.binary())], names=["block", "shard", "bits"])

    counted = dealt.groupBy(block).applyInArrow(count, "shard long, block long, cells binary")
    sketch = counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "block long, shard long, bits binary")

    def send(group: pa.Table, told: pa.Table) -> pa.Table:
        held = Windows(group["text"], window)
        keys = held.keys(gram)
        at, _ = block_sketch(held.row, keys, sketches, width)
        bits = dict(zip(told["shard"].to_pylist(), told["bits"].to_pylist(), strict=True))
        often = np.zeros(len(at), bool)
        for s, lo, hi in by_shard(at):
            often[lo:hi] = np.unpackbits(np.frombuffer(bits[s], np.uint8), count=hi - lo, bitorder="little")
        distinct, back = np.unique(keys, return_inverse=True)
        chosen = np.flatnonzero(estimated_repeated(distinct, at, often, sketches, width)[back]) if len(keys) else back
        a, b = held.first()[chosen], held.second()[chosen]
        doc = _ids(group["doc_id"])[held.row[chosen]]
        order, number, least, most = bounds_of_equals(a, b, doc, doc)
        first = np.flatnonzero(np.diff(number, prepend=-1))
        a, b = a[order][first], b[order][first]
        where = np.full(len(a), group[block][0].as_py() if group.num_rows else 0, np.int64)
        return pa.table({"shard": (a % np.uint64(shards)).astype(np.int64), "a": a.view(np.int64), "b": b.view(np.int64), "block": where, "least": least, "most": most})

    kind = "shard long, a long, b long, block long, least long, most long"
    sent = dealt.groupBy(block).cogroup(sketch.groupBy("block")).applyInArrow(send, kind)

    def answers(batches):
        for _, run in groups_of(batches, 0):
            a, b, where, least, most = (run[c].to_numpy() for c in ("a", "b", "block", "least", "most"))
            order, at, first, _ = bounds_of_equals(a, b, least, most)
            later = first[at] < most[order]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (where[order][later], a[order][later], b[order][later], first[at][later])], names=["block", "a", "b", "first"])

    found = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(answers, "block long, a long, b long, first long")
    names, kinds = docs.columns, docs.schema

    def kept(group: pa.Table, hits: pa.Table) -> pa.Table:
        if hits.num_rows:
            held = Windows(group["text"], window)
            ha, hb, first = (hits[c].to_numpy() for c in ("a", "b", "first"))
            known, ids = held.first(), _ids(group["doc_id"])
            near = np.flatnonzero(np.isin(known, ha.view(np.uint64)))
            a, b, doc = known[near], held.second()[near], ids[held.row[near]]
            # Hits come first in each group of equals: a hit has the least id of all, the documents' own are at least that.
            order, at, least, _ = bounds_of_equals(np.concatenate([a, ha.view(np.uint64)]), np.concatenate([b, hb.view(np.uint64)]), np.concatenate([doc, first]), np.concatenate([doc, first]))
            mine = order < len(a)
            own = order[mine]
            again = held.start[near[own[least[at[mine]] < doc[own]]]]
            change = np.zeros(len(held.hashes) + 1, np.int64)
            np.add.at(change, again, 1)
            np.add.at(change, again + window, -1)
            stays, words, ends = np.cumsum(change[:-1]) == 0, held.words, held.ends
        else:
            words = [(t or b"").split() for t in texts(group["text"])]
            ends = np.cumsum([len(x) for x in words], dtype=np.int64)
            stays = None
        out, n_removed = [], []
        for mine, end in zip(words, ends.tolist(), strict=True):
            here = None if stays is None else stays[end - len(mine) : end]
            left = mine if here is None or here.all() else [mine[k] for k in np.flatnonzero(here).tolist()]
            n_removed.append(len(mine) - len(left))
            out.append(b" ".join(left))
        columns = {c: group[c] for c in names} | {"text": pa.array(out, pa.binary()).cast(pa.string())}
        return pa.table(columns | {"n_words": pa.array([len(x) for x in words], pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})

    schema = type(kinds)(list(kinds)).add("n_words", "long").add("n_removed", "long")
    return dealt.groupBy(block).cogroup(found.groupBy("block")).applyInArrow(kept, schema)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def op9_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), least AS (
  SELECT h, min(doc_id) AS f FROM win GROUP BY h
), dup AS (
  SELECT DISTINCT doc_id, i FROM win JOIN least USING (h) WHERE f < doc_id
), word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), marked AS (
  SELECT word.doc_id, word, p, max(dup.i) OVER (PARTITION BY word.doc_id ORDER BY p) AS last
  FROM word LEFT JOIN dup ON dup.doc_id = word.doc_id AND dup.i = word.p
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE last IS NULL OR p - last >= 50) AS text,
         count(*) FILTER (WHERE p - last < 50) AS n FROM marked GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
