"""Benchmark decontamination by the q-gram lemma.

Benchmark texts are looked for whole, if they aren't long, and cut into
overlapping segments, so that a passage is found too. If a document holds a segment with at
most k edits, the two share at least m - q + 1 - k * q of the segment's m - q
+ 1 q-grams, and these lie on k + 1 neighbouring diagonals. Shared q-grams are
counted in bands of twice that width that overlap by half; bands that meet the
bound are verified by a banded alignment.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.llm.support import small, table

#: q-gram length, edits per character, longest text looked for whole, and length and step of the segments of all texts.
Q, RATE, WHOLE, SEGMENT, STEP = 8, 0.1, 300, 100, 25
#: Benchmark characters held at once on each executor; documents are read once per so many.
BENCHMARK_CHARS = 16 << 20
#: Characters of documents looked up at once.
STRETCH = 1 << 19
#: Postings looked at together.
PORTION = 1 << 22
#: Stands for a null item id.
NO_ITEM = -(1 << 63)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: ASCII characters that aren't letters or digits become blanks.
PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def normalised(text: str | None) -> str:
    """Lower case, without ASCII punctuation, one blank between words."""
    return b" ".join((text or "").lower().encode().translate(PLAIN).split()).decode()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, block, size, factor = None, c.astype(np.uint64), 1, int(FACTOR)
    done = 0
    while done < q:
        if q & size:
            out = block if out is None else out[: len(c) - done - size + 1] * np.uint64(factor) + block[done : len(c) - size + 1]
            done += size
        if done < q:
            block = block[:-size] * np.uint64(factor) + block[size:]
            size, factor = 2 * size, factor * factor & 0xFFFFFFFFFFFFFFFF
    return (out ^ (out >> np.uint64(29))) * FACTOR


def banded_edits(segment: np.ndarray, text: np.ndarray, lo: int, hi: int, k: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of segment in text on diagonals lo..hi, or None beyond k edits.

    The occurrence starts anywhere on these diagonals; of equal edits the
    first end is taken.
    """
    m, n = len(segment), len(text)
    diagonal = np.arange(lo, hi + 1)
    far = m + 1
    steps = np.arange(len(diagonal))
    now = np.where((diagonal >= 0) & (diagonal <= n), 0, far)
    for i in range(m):
        at = diagonal + i
        inside = (at >= 0) & (at < n)
        differs = np.ones(len(at), np.int64)
        differs[inside] = text[at[inside]] != segment[i]
        new = np.where(inside, now + differs, far)
        new[:-1] = np.minimum(new[:-1], now[1:] + 1)
        new[(at + 1 < 0) | (at + 1 > n)] = far
        new = np.minimum.accumulate(new - steps) + steps
        new[(at + 1 < 0) | (at + 1 > n)] = far
        if new.min() > k:
            return None
        now = new
    best = int(now.min())
    return (best, int(diagonal[int(now.argmin())] + m)) if best <= k else None


class BenchmarkIndex:
    """q-gram postings of some benchmark texts and of their segments.

    Texts of up to ``uncut`` characters are looked for whole alone; find_leaks
    cuts all that are longer than a segment.
    """

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE, uncut: int = 120):
        # Whole texts first: where one is found, its segments need no look.
        self.q, owners, parts = q, defaultdict(set), defaultdict(set)
        for item, text in items:
            text = normalised(text)
            if q <= len(text) <= WHOLE:
                owners[text].add(item)
            if len(text) > max(uncut, SEGMENT):
                for i in [*range(0, len(text) - SEGMENT, STEP), len(text) - SEGMENT]:
                    parts[text[i : i + SEGMENT]].add(item)
        self.segments = [*owners, *parts]
        self.whole = len(owners)
        self.items = [sorted(x) for x in (*owners.values(), *parts.values())]
        self.codes = [codes(s) for s in self.segments]
        size = np.array([len(s) for s in self.segments], np.int64)
        self.edits = np.minimum((size * rate).astype(np.int64), (size - q) // q)
        self.bound = size - q + 1 - self.edits * q
        self.longest = int(size.max() + 4 * self.edits.max() + 8) if len(size) else 0
        keys = [grams(c, q) for c in self.codes]
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.keys, starts = np.unique(key[order], return_index=True)
        self.starts = np.append(starts, len(key))
        self.of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[order] if keys else np.zeros(0, np.int64)
        self.at = np.concatenate([np.arange(len(k)) for k in keys])[order] if keys else np.zeros(0, np.int64)
        self.bits = max(16, (4 * len(self.keys)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True

    def candidates(self, c: np.ndarray, begin: np.ndarray):
        """(segment, piece, lowest, highest diagonal) of the bands that meet the bound.

        c holds pieces of text with a 0 between them; begin has their first places.
        """
        key = grams(c, self.q)
        hit = np.flatnonzero(self.seen[key >> np.uint64(64 - self.bits)])
        slot = np.searchsorted(self.keys, key[hit])
        slot[slot == len(self.keys)] = 0
        same = self.keys[slot] == key[hit]
        hit, slot = hit[same], slot[same]
        times = self.starts[slot + 1] - self.starts[slot]
        pieces, stripes = len(begin), 2 * (len(c) + self.longest)
        owned = lambda post, pos: (self.of[post] * pieces + np.searchsorted(begin, pos, side="right") - 1) * stripes + (pos - self.at[post] + self.longest) // (self.edits[self.of[post]] + 1)
        # In portions of a bounded number of postings, however often a q-gram repeats.
        portions = np.searchsorted(np.cumsum(times) // PORTION, np.arange(int(times.sum()) // PORTION + 2))

        def shared():
            for a, b in zip(portions[:-1], portions[1:], strict=True):
                n = times[a:b]
                post = np.repeat(self.starts[slot[a:b]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                yield owned(post, np.repeat(hit[a:b], n)), self.at[post]

        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for owner, _ in shared():
            new, n = np.unique(owner, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        both = counts.copy()
        both[:-1] += np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
        chosen = keys[both >= self.bound[keys // stripes // pieces]]
        if not len(chosen):
            return
        # Once more, each q-gram of the segment counted once, though the text repeat it.
        found = np.zeros(0, np.int64)
        for owner, at in shared():
            for x in (owner, owner - 1):
                place = np.minimum(np.searchsorted(chosen, x), len(chosen) - 1)
                of = chosen[place] == x
                found = np.unique(np.concatenate([found, place[of] * self.longest + at[of]]))
        distinct = np.bincount(found // self.longest, minlength=len(chosen))
        for x in chosen[distinct >= self.bound[chosen // stripes // pieces]].tolist():
            owner, stripe = divmod(x, stripes)
            segment, where = divmod(owner, pieces)
            k = int(self.edits[segment])
            low = stripe * (k + 1) - self.longest
            yield segment, where, low - k, low + 2 * (k + 1) - 1 + k

    def find(self, docs: list[str]):
        """Yields (document's place, item, start, end, edits), the best match of each document and item."""
        best: dict[tuple[int, int], tuple[bool, int, int, int]] = {}
        held: list[tuple[int, int, str]] = []
        size = 0

        def look() -> None:
            c = codes("\0".join(t for _, _, t in held) + "\0")
            lengths = np.array([len(t) + 1 for _, _, t in held])
            begin = np.cumsum(lengths) - lengths
            for segment, where, lo, hi in self.candidates(c, begin):
                doc, at, text = held[where]
                part = segment >= self.whole
                # (part, 0) is the best that this segment can give.
                if all(best.get((doc, i), (True, 1)) < (part, 1) for i in self.items[segment]):
                    continue
                lo, hi, m, k = lo - int(begin[where]), hi - int(begin[where]), len(self.segments[segment]), int(self.edits[segment])
                left, right = max(0, lo), min(len(text), hi + m + 1)
                exact = text.find(self.segments[segment], left, right)
                if exact >= 0:
                    edits, end = 0, exact + m
                elif found := banded_edits(self.codes[segment], codes(text[left:right]), lo - left, hi - left, k):
                    edits, end = found[0], found[1] + left
                else:
                    continue
                for item in self.items[segment]:
                    new = (part, edits, at + max(0, end - m), at + end)
                    best[doc, item] = min(best.get((doc, item), new), new)

        for doc, text in enumerate(docs):
            for at in range(0, max(1, len(text) - self.longest), STRETCH):
                part = text[at : at + STRETCH + self.longest]
                if len(part) < self.q:
                    continue
                held.append((doc, at, part))
                size += len(part)
                if size >= STRETCH:
                    look()
                    held, size = [], 0
        if held:
            look()
        for (doc, item), (_, edits, start, end) in sorted(best.items()):
            yield doc, item, start, end, edits


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """A row per document and benchmark item it holds: doc_id, item_id, start, end, edits.

    docs has doc_id (long) and text; benchmark has item_id (long) and text.
    Both are compared in lower case, without ASCII punctuation. An item is
    held if the whole of it (up to WHOLE characters) or one of its segments is
    found with at most ``rate`` edits per character (fewer for texts so short
    that no q-gram would be left). Segments have SEGMENT characters and begin
    every STEP ones, so each verbatim passage of SEGMENT + STEP - 1 characters
    holds one. start and end are code points of the normalised text. A whole
    item goes before a segment; then the place with the fewest edits counts,
    then the first.

    The benchmark is the stated query set: it is held on executors in blocks
    of BENCHMARK_CHARS characters. Items of fewer than q normalised characters
    and null or empty texts match nothing. Repeated rows match each; null ids
    stay null. Empty tables give an empty table; extra columns are left out.
    """
    schema = "doc_id long, item_id long, start long, end long, edits long"
    found = None
    for items in _blocks(benchmark):

        def run(batches, items=items):
            index = _index(items.value, q, rate)
            for batch in small(batches):
                ids = batch.column(0)
                out = list(index.find([normalised(t) for t in batch.column(1).to_pylist()])) if index.segments else []
                place, item, start, end, edits = zip(*out, strict=True) if out else ([],) * 5
                item = [None if i == NO_ITEM else i for i in item]
                taken = ids.take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, *[pa.array(x, pa.int64()) for x in (item, start, end, edits)]], names=["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def _blocks(benchmark: DataFrame) -> list[Broadcast]:
    """(item_id, text) rows of the benchmark, in broadcasts of BENCHMARK_CHARS characters or so."""
    spark = benchmark.sparkSession
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // BENCHMARK_CHARS + 1
    block = F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))
    return [spark.sparkContext.broadcast([(i, t) for i, t in benchmark.where(block == b).select("item_id", "text").collect() if t]) for b in range(blocks)]


def _index(items: list[tuple[int | None, str]], q: int, rate: float) -> BenchmarkIndex:
    return BenchmarkIndex([(NO_ITEM if i is None else i, t) for i, t in items], q, rate, SEGMENT)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, as find_leaks finds them.

    Each row is judged where it is read, by its own text: no row goes or
    stays for another one's doc_id, and nothing is joined or shuffled. Null
    and empty texts stay. docs keeps its columns, whatever they are called.
    """
    for items in _blocks(benchmark):

        def run(batches, items=items):
            index = _index(items.value, q, rate)
            for batch in small(batches):
                held = {doc for doc, *_ in index.find([normalised(t) for t in batch["text"].to_pylist()])} if index.segments else ()
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in held], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_q_gram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
