"""SimHash near-dedup by multi-index hashing.

Equal fingerprints are one node. A fingerprint is cut into segments, and each
table has a key of one or several of them, longer for more fingerprints.
Fingerprints within the radius differ by few bits in at least one table's
segments, so each is looked up at the points of a small Hamming ball around
its value there; what the table holds is verified over all 64 bits. Buckets
where many fingerprints meet are linked in blocks, which report a spanning
forest and not their pairs; where even these would be too many, through the
points within half the radius. Links then become components.

The pipeline's near copies are found the same way, by longer fingerprints of
their shingle sets whose segments are the keys of more tables, and verified by
the exact Jaccard similarity of their shingle hashes.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.llm.components import components
from hopforge.llm.support import cut, fresh, groups_of, mixed, small, table, texts

#: A bucket with more entries or probes than these is linked in blocks of BLOCK fingerprints; its keys are dealt over SALTS parts of a join.
CROWDED, PROBED, BLOCK, SALTS = 32, 1024, 4096, 64
#: Segments of a fingerprint and how many of them make a key, shortest keys first: of 21, 26 and 32 bits.
SCHEMES = ((3, 1), (5, 2), (6, 3))
#: Near copies: bits of a fingerprint that are compared whole, evenly spread entries of a bucket, and the share of pairs that all tables miss.
WHOLE, ROOMY, MISSED = 128, 256, 0.005
#: Nodes of a block in which all pairs are verified.
SETS = 512


def fingerprint(text: bytes | None, shingle_words: int) -> int:
    """The fingerprint of a whole text, as a signed 64-bit number; 0 without words."""
    words = (text or b"").lower().split()  # of bytes: ASCII blanks and letters only
    if not words:
        return 0
    n, digest = shingle_words, xxhash.xxh64_intdigest
    if len(words) <= n:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def segments(radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius of the ball) of three segments.

    The balls' radii plus one each add up to radius + 1, so fingerprints
    within the radius can't miss all three balls.
    """
    near = [(radius - i) // 3 for i in range(3)]
    return [(at, bits, r) for (at, bits), r in zip([(0, 21), (21, 21), (42, 22)], near, strict=True) if r >= 0]


def tables(radius: int, scheme: tuple[int, int]) -> list[tuple[list[tuple[int, int]], int]]:
    """([(first bit, bits) of each segment of the key], radius of the ball) of each table.

    Of ``radius`` differing bits in m segments the cleanest c hold at most s,
    if s + (m - c) * ceil(s / c) > radius for any larger s.
    """
    m, c = scheme
    if c == 1:
        return [([(at, bits)], near) for at, bits, near in segments(radius)]
    ends = [64 * i // m for i in range(m + 1)]
    near = max(s for s in range(radius + 1) if s + (m - c) * -(-s // c) <= radius)
    return [([(ends[i], ends[i + 1] - ends[i]) for i in some], near) for some in combinations(range(m), c)]


def scheme_for(n: int) -> tuple[int, int]:
    """The shortest keys by which n evenly spread fingerprints fill a bucket with eight or fewer; else the longest."""
    for m, c in SCHEMES:
        if n <= 8 << (64 * c // m):
            return m, c
    return SCHEMES[-1]


def ball(bits: int, radius: int) -> list[int]:
    """All masks of up to radius ones among the low bits, zero first."""
    return [sum(1 << i for i in some) for ones in range(radius + 1) for some in combinations(range(bits), ones)]


def spanning_forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indices) that connect all fingerprints, of a word or a row of words each, connected by links within the radius."""
    left, out = np.arange(len(prints)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            far = np.bitwise_count(prints[left] ^ prints[at])
            near = (far if far.ndim == 1 else far.sum(1)) <= radius
            if near.any():
                reached = left[near].tolist()
                out += [(at, x) for x in reached]
                queue += reached
                left = left[~near]
    return out


def _links(prints: DataFrame, radius: int, scheme: tuple[int, int]) -> DataFrame:
    """(a, b) of distinct fingerprints ``f``: enough links for all components."""
    probes = []
    for i, (parts, near) in enumerate(tables(radius, scheme)):
        value, width = F.lit(0).cast("long"), 0
        for at, bits in parts:
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("f", at).bitwiseAND(F.lit((1 << bits) - 1)), width))
            width += bits
        masks = ball(width, near)
        if near == 1:
            # Of two values one bit apart, only the even one looks for the other.
            every = F.when(F.bit_count(value) % 2 == 0, F.array(*map(F.lit, masks))).otherwise(F.array(F.lit(0)))
        else:
            every = F.array(*map(F.lit, masks))
        key = (F.col("v").bitwiseXOR(F.col("mask").cast("long")) + F.lit(i << 40)).alias("key")
        probes.append(prints.select(F.explode(every).alias("mask"), "f", value.alias("v")).select(key, "f", (F.col("mask") == 0).alias("own")))
    # A table's entries are the probes with the mask zero.
    probes = reduce(DataFrame.unionByName, probes)
    salt = F.pmod(F.xxhash64("f"), F.lit(SALTS)).cast("int")
    crowded = probes.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("entries")).where(((F.col("entries") > CROWDED) | (F.col("n") > PROBED)) & (F.col("entries") > 0))
    crowded = cut(crowded.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    roomy = probes.where("own").withColumn("salt", salt).join(crowded.select("key", "salt"), ["key", "salt"], "left_anti").select("key", F.col("f").alias("f2"))
    close = F.bit_count(F.col("f").bitwiseXOR(F.col("f2"))) <= radius
    few = probes.join(roomy, "key").where((F.col("f") != F.col("f2")) & close).select(F.col("f").alias("a"), F.col("f2").alias("b"))

    # What meets in a crowded bucket is dealt into blocks, and each pair of blocks is linked once. A fingerprint is
    # sent to every block of its bucket, or to the points around it, whichever are fewer.
    points = ball(64, radius // 2) if radius % 2 == 0 else None
    meeting = cut(probes.withColumn("salt", salt).join(crowded, ["key", "salt"]).select("key", "f", "blocks"))
    blocks = meeting if points is None else meeting.where(F.col("blocks") <= len(points))
    block = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    dealt = blocks.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "f")

    def forests(batches):
        for _, run in groups_of(batches, 0):
            nodes = np.unique(run["f"].to_numpy())
            found = np.array(spanning_forest(nodes.view(np.uint64), radius), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[found[:, i]]) for i in (0, 1)], names=["a", "b"])

    links = few.unionByName(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(forests, "a long, b long"))
    if points is None or not (huge := meeting.where(F.col("blocks") > len(points))).take(1):
        return links
    # Fingerprints within half the radius of a point are within the radius of each other, and any two within the radius share a point.
    around = huge.select("f").distinct().select("f", F.explode(F.array(*map(F.lit, map(_signed, points)))).alias("mask")).select("f", F.col("f").bitwiseXOR(F.col("mask")).alias("point"))
    least = around.groupBy("point").agg(F.min("f").alias("b"))
    return links.unionByName(around.join(least, "point").where("f <> b").select(F.col("f").alias("a"), "b").distinct())


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """A row per document: doc_id, fingerprint (long), component_id.

    docs has doc_id (long) and text (string). A-Z become lower case; words are
    runs without ASCII blanks; shingles of shingle_words words are hashed by
    XXH64 with seed 42. A fingerprint bit is one if it is one in over half of
    the hashes; a text with fewer words is one shingle, one without words (a
    null or empty text) has the fingerprint zero and is linked like any other.
    Fingerprints within ``radius`` bits are linked; component_id is the
    smallest doc_id reachable over links.

    Repeated rows give repeated rows; null doc_ids are never the smallest
    unless all in reach are null. Extra columns are left out; an empty table
    gives an empty table.
    """

    def run(batches):
        for batch in small(batches):
            prints = [fingerprint(t, shingle_words) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "f"])

    marked = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, f long"))
    prints = cut(marked.groupBy("f").agg(F.min("doc_id").alias("first")))
    roots = components(_links(prints.select("f"), radius, scheme_for(prints.count())))
    named = _named(marked.withColumn("node", F.col("f")), prints.withColumn("node", F.col("f")), roots)
    return named.select("doc_id", F.col("f").alias("fingerprint"), "component_id")


def shingles(text: bytes | None, shingle_words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; none without words."""
    words = (text or b"").lower().split()
    n, digest = shingle_words, xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    return np.unique(np.array([digest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)], np.uint64))


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The 64 * words bits of the SimHash of a set of shingle hashes, each hash mixed anew for each word."""
    ones, salts = np.zeros(64 * words, np.int64), np.arange(words, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for at in range(0, len(hashes), 255):  # counts of up to 255 fit into a byte
        some = mixed(hashes[at : at + 255, None] + salts).astype("<u8").view(np.uint8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return 2 * ones > len(hashes)


def search_for(n: int, similarity: float) -> tuple[int, int, int]:
    """(bits of a key, tables, radius over WHOLE bits) that find n texts' pairs of a similarity.

    Sets of Jaccard similarity s have a cosine of 2s / (1 + s) or more, and
    their fingerprints differ in a bit with a chance of its angle by pi. Keys
    grow with n, so that a bucket holds ROOMY of evenly spread fingerprints at
    most, and tables with the keys, so that a pair misses all with a chance of
    MISSED. The radius leaves out differences 3.6 deviations above the mean.
    """
    differ = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    bits = max(12, math.ceil(math.log2(max(1, n) / ROOMY)))
    met = (1 - differ) ** bits
    count = 1 if met == 1 else math.ceil(math.log(MISSED) / math.log1p(-met))
    return bits, count, math.ceil(WHOLE * differ + 3.6 * math.sqrt(WHOLE * differ * (1 - differ)))


def table_keys(print_: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The key in each of ``count`` tables: its number and its own segment of the fingerprint."""
    return print_[: bits * count].reshape(count, bits) @ (1 << np.arange(bits)) + (np.arange(count) << bits)


def close_forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """As spanning_forest; those close to no other are sorted out before."""
    n = len(prints)
    close, step = np.zeros(n, bool), max(1, (1 << 18) // n)
    for at in range(0, n, step):
        far = np.zeros((min(step, n - at), n), np.uint8)
        for word in prints.T:
            far += np.bitwise_count(word[at : at + step, None] ^ word)
        close[at : at + step] = (far <= radius).sum(1) > 1
    some = np.flatnonzero(close)
    return [(int(some[i]), int(some[j])) for i, j in spanning_forest(prints[some], radius)] if len(some) else []


def _buckets(batches, most: int):
    """(columns, whole) of each bucket in rows sorted by the first column.

    A bucket of more than ``most`` rows comes in pieces that aren't whole, so
    it's never held.
    """
    held, over = None, None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        edges = [0, *(np.flatnonzero(now[0][1:] != now[0][:-1]) + 1).tolist(), len(now[0])]
        for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
            part = [c[lo:hi] for c in now]
            yield part, hi - lo <= most and part[0][0] != over
        held = [c[edges[-2] :] for c in now]
        if len(held[0]) > most or held[0][0] == over:
            yield held, False
            held, over = None, now[0][-1]
    if held is not None:
        yield held, True


def _close(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) of nodes that share a key and whose prints are within the radius: enough links for all components.

    nodes has node, its keys, and the first WHOLE bits of its fingerprint as p and q.
    """
    # In order of nodes, so that the buckets of all tables link their nodes to the same few smallest ones.
    found = nodes.select(F.explode("keys").alias("key"), "node", "p", "q").repartition("key").sortWithinPartitions("key", "node")

    def links(batches, most=BLOCK):
        a, b = [], []

        def out(columns):
            names = ["a", "b", "key", "p", "q"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if c is not None else pa.nulls(len(columns[0]), pa.int64()) for c in columns], names=names)

        for (keys, names, p, q), whole in _buckets(batches, most):
            if not whole:
                yield out([names, None, keys, p, q])
            elif len(names) > 1:
                linked = np.array(close_forest(np.stack([p, q], axis=1).view(np.uint64), radius), np.int64).reshape(-1, 2)
                a.append(names[linked[:, 0]])
                b.append(names[linked[:, 1]])
                if len(a) >= 1000:
                    yield out([np.concatenate(a), np.concatenate(b), None, None, None])
                    a, b = [], []
        if a:
            yield out([np.concatenate(a), np.concatenate(b), None, None, None])

    schema = "a long, b long, key long, p long, q long"
    found = cut(found.mapInArrow(links, schema))
    linked, crowded = found.where("key IS NULL").select("a", "b"), found.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "p", "q")
    if not crowded.take(1):
        return linked
    # A crowded bucket is dealt into blocks, and each pair of blocks is linked once.
    sized = crowded.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = crowded.join(sized, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node", "p", "q")
    more = dealt.repartition("group").sortWithinPartitions("group", "node").mapInArrow(lambda batches: links(batches, 1 << 40), schema)
    return linked.unionByName(more.select("a", "b"))


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (indices) that connect all sets connected by pairs of at least this Jaccard similarity."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(int(codes.max()) + 1, bool)
    left, out = np.arange(len(sets)), []
    flat, where = codes, starts
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        flat, where = flat[len(flat) - int(sizes[left].sum()) :], np.cumsum(sizes[left]) - sizes[left]
        while queue and len(left):
            at = queue.pop()
            own = codes[starts[at] : starts[at] + sizes[at]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], where, dtype=np.int64)
            mark[own] = False
            near = both >= similarity * (sizes[left] + sizes[at] - both) - 1e-6
            if near.any():
                reached = left[near].tolist()
                out += [(at, x) for x in reached]
                queue += reached
                flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
                where = np.cumsum(sizes[left]) - sizes[left]
    return out


def _fewer(links: DataFrame) -> DataFrame:
    """(a, b): each a linked to the smallest of its bs, and the other bs to it; components stay as they are.

    The tables differ in who is in a bucket, so a node of a large group is
    linked to several of the smallest ones; links among those few are equal.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    among = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(among.distinct())


def _similar(docs: DataFrame, nodes: DataFrame, radius: int, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b) of nodes that the fingerprints find and that are similar: enough links for all components.

    docs has (doc_id, text, copy); nodes has the doc_id and copy that stand for
    each node, its keys and bits. What the fingerprints connect is a group, in
    which all pairs are verified. Only grouped nodes have their shingles held,
    worked out once more from the texts.
    """
    roots = components(_fewer(_close(nodes, radius)))
    grouped = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    who = nodes.join(grouped, "node", "left_semi").select("node", F.col("doc_id").alias("id_"), F.col("copy").alias("copy_"))

    def again(batches):
        for batch in small(batches):
            held = [shingles(t, shingle_words).astype("<u8").tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["node", "shingles"])

    own_texts = docs.join(who, docs["doc_id"].eqNullSafe(who["id_"]) & (docs["copy"] == who["copy_"])).select("node", "text")
    held = own_texts.mapInArrow(again, "node long, shingles binary").dropDuplicates(["node"])

    # A large group is dealt into blocks, and each pair of blocks is linked once.
    sized = grouped.groupBy("root").agg(F.ceil(F.count("*") / SETS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = grouped.join(sized, "root").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node").join(held, "node").select("group", "node", "shingles")

    def forests(batches):
        for _, run in groups_of((part for batch in batches for part in small([batch])), 0):
            names = run["node"].to_numpy()
            found = np.array(similar_forest([np.frombuffer(x, "<u8") for x in run["shingles"].to_pylist()], similarity), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[found[:, i]]) for i in (0, 1)], names=["a", "b"])

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(forests, "a long, b long")


def _components(docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """A row per document: doc_id, copy (a hash of its text), node (of its shingles), root (of its component) and component_id."""
    bits, count, radius = search_for(docs.count(), similarity)
    words = max(WHOLE // 64, -(-bits * count // 64))

    def run(batches):
        for batch in small(batches):
            every = [shingles(t, shingle_words) for t in texts(batch.column(1))]
            node = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in every]
            prints = [long_fingerprint(x, words) for x in every]
            keys = [table_keys(f, bits, count) if len(x) else [] for x, f in zip(every, prints, strict=True)]
            p, q = (pa.array([np.packbits(f[at : at + 64], bitorder="little").view("<i8")[0] for f in prints], pa.int64()) for at in (0, 64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), p, q], names=["doc_id", "copy", "node", "keys", "p", "q"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy"))
    marked = docs.mapInArrow(run, "doc_id long, copy long, node long, keys array<long>, p long, q long")
    marked = cut(marked.withColumn("row", F.monotonically_increasing_id()))
    prints = cut(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row")))
    # Of equal shingle sets one row stands for all.
    nodes = marked.join(prints.select("row"), "row", "left_semi")
    roots = components(_similar(docs, nodes, radius, shingle_words, similarity))
    return _named(marked.select("doc_id", "copy", "node"), prints.select("node", "first"), roots)


def near_copies(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """A row per document: doc_id, component_id, by the Jaccard similarity of the texts' sets of word shingles.

    Texts of equal sets are one node. Near copies are found by SimHash and
    multi-index hashing: a set's fingerprint has a segment for each of the
    tables, and nodes that share a table's key and differ by few of the first
    WHOLE bits are close. 36 tables of 12 bits find a pair of similarity 0.8
    with a chance of 0.995, less in sets of some ten shingles. No pair is
    linked unless the exact similarity of its 64-bit shingle hashes is at
    least ``similarity``. A text of fewer words is one shingle; texts without
    words are copies of each other. component_id is the smallest doc_id
    reachable over links. Other cases as in near_duplicates.
    """
    return _components(docs, shingle_words, similarity).select("doc_id", "component_id")


def _named(marked: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """marked (with node) and component_id, the smallest ``first`` of a component's prints."""
    rooted = prints.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    # Cut off, so that a component with very many nodes can be split where it is joined.
    named = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return marked.join(rooted.join(named, "root").select("node", "root", "component_id"), "node")


def keep_first_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies of a smaller doc_id; repeated rows of the first stay once.

    Rows are judged by doc_id and text, so different texts of one id, or
    without one, go only if they are near copies; null ids count as the largest.
    """
    found = _components(docs, 5, 0.8)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id_"), F.col("copy").alias("copy_"))
    first = found.groupBy("root").agg(F.min(order).alias("x")).select("x.id_", "x.copy_")
    names, copy = docs.columns, F.xxhash64("text")
    mine = docs.join(first, docs["doc_id"].cast("long").eqNullSafe(first["id_"]) & (copy == first["copy_"]), "left_semi")
    key = fresh(names, "copy")
    return mine.withColumn(key, copy).dropDuplicates(["doc_id", key]).select(*names)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
