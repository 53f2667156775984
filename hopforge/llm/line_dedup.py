"""Line dedup by a sharded minimal perfect hash.

Documents are dealt into blocks, and blocks hash the keys of their lines. How
many documents hold each hash is an aggregate. A shard owns a part of the hash
space: over the distinct hashes in it that enough documents hold it builds a
minimal perfect hash and fills fingerprint, count and last-document arrays by
it. Then every block asks the shards for its distinct hashes, packed, and is
answered from the arrays: most of its lines are strangers there, which the
fingerprints refuse. Blocks then drop their lines; lines and documents are
never joined with each other.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.llm.support import fresh, mixed, table, texts, without

#: Text bytes per block and per shard, and blocks that one task answers for a shard.
BLOCK_BYTES, SHARD_BYTES, BLOCKS_PER_TURN = 2 << 20, 16 << 20, 1 << 14
#: Stands for a null document id, which counts as one document before all others.
NO_ID = -(1 << 63)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys, given as two uint64 arrays.

    Level by level, keys that meet no other key at their slot keep it; the
    rest try the next level. A key's index is the rank of its slot among all
    kept slots. Keys left over after LEVELS levels are listed one by one.
    """

    LEVELS, SLACK = 24, 1.6

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n, self.levels, base = len(a), [], 0
        for level in range(self.LEVELS):
            if not len(a):
                break
            width = int(len(a) * self.SLACK) + 8
            slot = self._slot(a, b, level, width)
            once = np.bincount(slot, minlength=width) == 1
            rank = np.cumsum(once, dtype=np.int64) - 1 + base
            self.levels.append((width, once, rank))
            base += int(once.sum())
            rest = ~once[slot]
            a, b = a[rest], b[rest]
        self.left = {key: base + i for i, key in enumerate(zip(a.tolist(), b.tolist(), strict=True))}

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray, level: int, width: int) -> np.ndarray:
        return (mixed(a ^ mixed(b, level), level) % np.uint64(width)).astype(np.int64)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key in 0..n-1; -1, or any index, for keys that aren't in the set."""
        out, todo = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (width, once, rank) in enumerate(self.levels):
            slot = self._slot(a[todo], b[todo], level, width)
            found = once[slot]
            out[todo[found]] = rank[slot[found]]
            todo = todo[~found]
        for i in todo.tolist():
            out[i] = self.left.get((int(a[i]), int(b[i])), -1)
        return out


class LineIndex:
    """Compact arrays over distinct line hashes, in the order of a perfect hash: fingerprint, count, last document."""

    def __init__(self, a: np.ndarray, b: np.ndarray, count: np.ndarray, last: np.ndarray):
        self.hash = PerfectHash(a, b)
        at = self.hash.index(a, b)
        self.fingerprint, self.count, self.last = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
        self.fingerprint[at], self.count[at], self.last[at] = b, np.minimum(count, (1 << 32) - 1), last

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count and last document of each hash; count 0 for a stranger.

        A stranger's index, if it has one, is some other line's, whose
        fingerprint refuses it but for a chance of 2^-64.
        """
        if not self.hash.n:
            return np.zeros(len(a), np.int64), np.full(len(a), NO_ID, np.int64)
        at = self.hash.index(a, b)
        known = (at >= 0) & (self.fingerprint[at] == b)
        return np.where(known, self.count[at], 0), np.where(known, self.last[at], NO_ID)

    def packed(self) -> bytes:
        levels = [(width, np.packbits(once).tobytes()) for width, once, _ in self.hash.levels]
        return pickle.dumps((self.hash.n, levels, self.hash.left, self.fingerprint.tobytes(), self.count.tobytes(), self.last.tobytes()))

    @classmethod
    def unpacked(cls, data: bytes) -> LineIndex:
        out, of = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        of.n, levels, of.left, *arrays = pickle.loads(data)
        of.levels, base = [], 0
        for width, bits in levels:
            once = np.unpackbits(np.frombuffer(bits, np.uint8), count=width).astype(bool)
            of.levels.append((width, once, np.cumsum(once, dtype=np.int64) - 1 + base))
            base += int(once.sum())
        out.hash = of
        out.fingerprint, out.count, out.last = (np.frombuffer(x, kind) for x, kind in zip(arrays, (np.uint64, np.uint32, np.int64), strict=True))
        return out


def line_key(line: bytes, least: int) -> bytes | None:
    """A line's key, or None if it has fewer than ``least`` code points."""
    key = line.strip().lower()  # of bytes: ASCII blanks and letters only
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _ids(column: pa.ChunkedArray) -> list[int]:
    return [NO_ID if x is None else x for x in column.to_pylist()]


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with the lines gone that repeat across documents, plus n_lines and n_dropped.

    docs has doc_id (long) and text (string). A line's key is the line without
    blanks at its ends and with A-Z in lower case. Keys of at least min_chars
    code points that at least min_docs documents hold lose all their lines but
    those of the largest doc_id holding them. Kept lines are joined by \\n.

    Rows of equal doc_id are one document when documents are counted; each row
    stays. A null doc_id counts as one document before all others. A null or
    empty text is one empty line and stays as it is. An empty table gives an
    empty table. All other columns stay; n_lines and n_dropped are replaced if
    they are there already.
    """
    docs = without(docs, "n_lines", "n_dropped")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = size // BLOCK_BYTES + 1, size // SHARD_BYTES + 1
    # A line that every block holds is asked for once a block, so a shard's arrays serve several tasks.
    turns = blocks // BLOCKS_PER_TURN + 1
    block = fresh(docs.columns, "block")
    dealt = docs.withColumn(block, F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)))

    def held_keys(group: pa.Table) -> dict[bytes, list[int]]:
        """Each key of the block: how many documents with an id hold it, whether one without does, and the last of them."""
        held: dict[bytes, list[int]] = {}
        for doc, text in sorted(zip(_ids(group["doc_id"]), texts(group["text"]), strict=True), key=lambda r: r[0]):
            for line in (text or b"").split(b"\n"):
                if len(line) >= min_chars and (key := line_key(line, min_chars)):
                    if (seen := held.get(key)) is None:
                        seen = held[key] = [0, 0, NO_ID]
                    if doc == NO_ID:
                        seen[1] = 1
                    elif seen[2] != doc:
                        seen[0] += 1
                        seen[2] = doc
        return held

    def count(group: pa.Table) -> pa.Table:
        held = held_keys(group)
        both = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
        columns = {name: np.array([v[i] for v in held.values()], np.int64) for i, name in enumerate(("n", "none", "last"))}
        return pa.table({"a": both[:, 0], "b": both[:, 1]} | columns)

    # One row a line and task before the shuffle, however many blocks hold it.
    counts = dealt.groupBy(block).applyInArrow(count, "a long, b long, n long, none long, last long").groupBy("a", "b").agg((F.sum("n") + F.max("none")).alias("n"), F.max("last").alias("last"))
    shard = F.pmod(F.col("a"), F.lit(shards))

    def build(group: pa.Table) -> pa.Table:
        a, b, n, last = (group[c].to_numpy() for c in ("a", "b", "n", "last"))
        index = LineIndex(a.view(np.uint64), b.view(np.uint64), n, last)
        return pa.table({"shard": group["shard"].slice(0, 1), "arrays": pa.array([index.packed()], pa.binary())})

    indexes = counts.where(F.col("n") >= min_docs).withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, arrays binary")
    indexes = indexes.select("shard", "arrays", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"))

    def ask(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join({key for text in texts(group["text"]) for line in (text or b"").split(b"\n") if len(line) >= min_chars and (key := line_key(line, min_chars))}), "<i8").reshape(-1, 2)
        of = np.mod(keys[:, 0], shards)
        order = np.argsort(of, kind="stable")
        asked, first = np.unique(of[order], return_index=True)
        ends = [*first[1:].tolist(), len(of)][: len(first)]
        number = group[block][0].as_py() if group.num_rows else 0
        rows = [keys[order[lo:hi]].tobytes() for lo, hi in zip(first.tolist(), ends, strict=True)]
        return pa.table({"shard": pa.array(asked, pa.int64()), "turn": pa.array([number % turns] * len(rows), pa.int64()), "block": pa.array([number] * len(rows), pa.int64()), "keys": pa.array(rows, pa.binary())})

    asked = dealt.groupBy(block).applyInArrow(ask, "shard long, turn long, block long, keys binary")

    def probe(questions: pa.Table, arrays: pa.Table) -> pa.Table:
        blocks_, out = [], []
        if arrays.num_rows:
            index = LineIndex.unpacked(arrays["arrays"][0].as_py())
            for number, keys in zip(questions["block"].to_pylist(), questions["keys"], strict=True):
                both = np.frombuffer(keys.as_buffer(), "<i8").reshape(-1, 2)
                n, last = index.probe(both[:, 0].view(np.uint64), both[:, 1].view(np.uint64))
                if len(at := np.flatnonzero(n)):
                    blocks_.append(number)
                    out.append(np.column_stack([both[at], last[at]]).tobytes())
        return pa.table({"block": pa.array(blocks_, pa.int64()), "hits": pa.array(out, pa.binary())})

    found = asked.groupBy("shard", "turn").cogroup(indexes.groupBy("shard", "turn")).applyInArrow(probe, "block long, hits binary")

    names, kinds = docs.columns, docs.schema

    def kept(group: pa.Table, hits: pa.Table) -> pa.Table:
        stays = {}
        for packed in hits["hits"].to_pylist():
            last = np.frombuffer(packed, "<i8")[2::3].tolist()
            stays.update((packed[24 * i : 24 * i + 16], x) for i, x in enumerate(last))
        out, lines, dropped = [], [], []
        for doc, text in zip(_ids(group["doc_id"]), texts(group["text"]), strict=True):
            every = (text or b"").split(b"\n")
            left = [x for x in every if len(x) < min_chars or (key := line_key(x, min_chars)) is None or stays.get(key, doc) == doc] if stays else every
            lines.append(len(every))
            dropped.append(len(every) - len(left))
            out.append(text if len(left) == len(every) else b"\n".join(left))
        columns = {c: group[c] for c in names} | {"text": pa.array(out, pa.binary()).cast(pa.string())}
        return pa.table(columns | {"n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    schema = type(kinds)(list(kinds)).add("n_lines", "long").add("n_dropped", "long")
    return dealt.groupBy(block).cogroup(found.groupBy("block")).applyInArrow(kept, schema)


def op5_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), line AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), often AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, coalesce(stays <> doc_id, false) AS gone FROM keyed LEFT JOIN often USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
