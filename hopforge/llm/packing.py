"""Packing by the sum-of-squares rule.

Documents become tokens, full windows are cut off, and the rest of each
document is placed online: of all fill levels where it fits, and an empty
window, it takes the one that leaves the smallest sum of squares of the
numbers of partly filled windows per level. The numbers are kept in an array
indexed by level. Sizes are all that a packer sees: tokens stay where they
were made, and packers of a fixed number of rests work side by side.

A packer knows how many tokens are still to come. Once they are no more than
the room of its partly filled windows, the rests that remain are cut to fill
these windows, the fullest first, so that a packer ends with less than one
window of padding or so. These last rests, and no others, carry their tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.llm.support import cut, groups_of, parts_for, small, table, texts

#: Rests per packer.
RESTS_PER_PACKER = 50_000


def last_share(rests: float) -> float:
    """The share of a packer's rests that may be cut: well over what its partly filled windows have room for.

    By the rule alone 13 % of the room stays open after 1000 rests, 8 % after
    10,000 and 6 % after 50,000. A packer that needs more cuts less padding away.
    """
    return min(1.0, 0.1 + 6 / max(rests, 1) ** 0.5)


class LevelArray:
    """Windows of ``width`` tokens, filled online by the sum-of-squares rule."""

    def __init__(self, width: int):
        self.width = width
        self.count = np.zeros(width + 1, np.int64)  # partly filled windows at each level; 0 and width stay 0
        self.open: list[list[int]] = [[] for _ in range(width + 1)]
        self.windows = self.room = 0  # room: tokens that all partly filled windows can still take

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for a piece of 1 to width tokens."""
        width, count = self.width, self.count
        if size == width:
            self.windows += 1
            return self.windows - 1, 0
        # Moving a window from level h to h + size changes the sum of squares by
        # (count[h + size] + 1)^2 - count[h + size]^2 - count[h]^2 + (count[h] - 1)^2.
        lows = count[1 : width - size + 1]
        change = 2 * (count[1 + size :] - lows) + 2
        if len(change):
            change[-1] = 1 - 2 * lows[-1]  # a full window is no longer counted
            change[lows == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
        fresh = 2 * int(count[size]) + 1
        if not len(change) or fresh < change[best]:
            level, window = 0, self.windows
            self.windows += 1
            self.room += width
        else:
            level = best + 1
            window = self.open[level].pop()
            count[level] -= 1
        self._filled(window, level + size, size)
        return window, level

    def cut(self, size: int) -> list[tuple[int, int, int]]:
        """(length, window, offset) of the pieces of ``size`` tokens, cut to fill the fullest windows; room must be enough."""
        out = []
        while size:
            level = int(self.count.nonzero()[0][-1])
            window, piece = self.open[level].pop(), min(size, self.width - level)
            self.count[level] -= 1
            self._filled(window, level + piece, piece)
            out.append((piece, window, level))
            size -= piece
        return out

    def _filled(self, window: int, level: int, size: int) -> None:
        self.room -= size
        if level < self.width:
            self.count[level] += 1
            self.open[level].append(window)


def pack(sizes: list[int], width: int, whole: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, window, offset) of pieces placed online, one after the other.

    The first ``whole`` pieces (all, if it isn't given) stay whole. Of the
    others those are cut that come when the rest of the stream fits into the
    partly filled windows.
    """
    levels, out, left = LevelArray(width), [], sum(sizes)
    for i, size in enumerate(sizes):
        if whole is None or i < whole or left > levels.room:
            window, offset = levels.place(size)
            out.append((i, 0, size, window, offset))
        else:
            start = 0
            for length, window, offset in levels.cut(size):
                out.append((i, start, length, window, offset))
                start += length
        left -= size
    return out


def _encoder(path: str):
    """A function from UTF-8 bytes to token ids, equal to the tokenizer file's own ids.

    The tokenizer's vocabulary and merges are handed to a faster byte-level
    BPE. Texts with its special strings, or with characters for which the two
    libraries' Unicode tables may differ, go to the tokenizer itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    specials = [t["content"] for t in spec.get("added_tokens", [])]
    # The public byte alphabet of byte-level BPE: printable bytes stand for themselves.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(letter[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in specials}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if (text.isascii() or max(text) < "ɐ") and not any(s in text for s in specials):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
#: Ids of rests travel as numbers of 16 or 32 bits.
SMALL = 1 << 16


def _tokens(docs: DataFrame, path: str, end_id: int, width: int, kind: str) -> DataFrame:
    """A row a piece, cut at full windows: COLUMNS and, of pieces that fill none, ids (of this numpy type)."""

    def run(batches):
        encode = _encoder(path)
        for batch in small(batches):
            out: list[list] = [[], [], [], [], []]
            kept: list[bytes | None] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.array([*encode((text or b"").decode()), end_id], "<u4")
                for start in range(0, len(ids), width):
                    piece = ids[start : start + width]
                    for held, x in zip(out, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        held.append(x)
                    kept.append(piece.astype(kind).tobytes() if len(piece) < width else None)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out], pa.array(kept, pa.binary())], names=[*COLUMNS, "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, width: int = 1024, end_id: int = 0, rests_per_packer: int = RESTS_PER_PACKER) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs has doc_id (long) and text (string). A document is its token ids and
    then end_id. It is cut at multiples of ``width``; the full pieces are
    sequences of their own, the rest is placed by the sum-of-squares rule. The
    last rests of each packer, last_share of them, are cut where that fills
    its windows. A sequence's pieces lie one behind the other from offset 0.

    A null or empty text is end_id alone. Repeated rows are packed each, a
    null doc_id like any other. An empty table gives an empty table; extra
    columns are left out. Rests meet their packer in the order of a hash of
    their contents, so which pieces share a sequence depends on the rows
    alone; only the odd numbers of the one-piece sequences depend on how the
    input is dealt, and those are numbered on the checkpoint, once.
    """
    kind = "<u2" if _largest_id(tokenizer, end_id) < SMALL else "<u4"
    made = cut(_tokens(docs, tokenizer, end_id, width, kind))
    n = made.where(F.col("length") < width).count()
    packers = parts_for(n, rests_per_packer)
    share = last_share(n / packers)
    mixed = F.xxhash64("doc_id", "ids_crc32", "start")
    rests = made.where(F.col("length") < width).withColumn("packer", F.pmod(mixed, F.lit(packers))).withColumn("turn", F.xxhash64("ids_crc32", "doc_id", F.lit(1)))
    # Turns are spread evenly over all longs; the largest are the last.
    last = F.col("turn") >= F.lit(max(-(1 << 63), int((1 - 2 * share) * (1 << 63))))
    rests = rests.withColumn("ids", F.when(last, F.col("ids")))

    def run(batches):
        for packer, rows in groups_of(batches, 5):  # of rests_per_packer rows or so
            sizes, ids = rows["length"].to_pylist(), rows["ids"]
            item, start, length, windows, offsets = (list(x) for x in zip(*pack(sizes, width, ids.null_count), strict=True))
            crcs = rows["ids_crc32"].take(pa.array(item)).to_pylist()
            for j, (i, s, size) in enumerate(zip(item, start, length, strict=True)):
                if size < sizes[i]:
                    crcs[j] = zlib.crc32(np.frombuffer(ids[i].as_buffer(), kind)[s : s + size].astype("<u4").tobytes())
            at = pa.array(item)
            numbers = pa.array([(int(packer) << 34) + (w << 1) for w in windows], pa.int64())
            begin = pa.array(rows["start"].take(at).to_numpy() + np.array(start))
            done = pa.table([rows["doc_id"].take(at), begin, pa.array(length, pa.int64()), pa.array(crcs, pa.int64()), rows["doc_tokens"].take(at), numbers, pa.array(offsets, pa.int64())], names=[*COLUMNS, "sequence_id", "offset"])
            yield from done.to_batches(max_chunksize=10_000)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = rests.repartition("packer").sortWithinPartitions("packer", "turn", "doc_id", "ids_crc32", "doc_tokens").select(*COLUMNS, "packer", "ids").mapInArrow(run, schema)
    full = made.where(F.col("length") == width).select(*COLUMNS, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(placed)


def _largest_id(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def op4_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
