import random

import duckdb
import numpy as np
import pytest
import xxhash

from hopforge.llm.components import components
from hopforge.llm.simhash import SCHEMES, _links, ball, fingerprint, keep_first_of_each, near_duplicates, op3_multi_index, scheme_for, segments, spanning_forest, tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text, n=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=4):
    root = dict(enumerate(range(len(prints))))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c d", "A b\tC d e\nf g ä é", "\x1ca\x1c b \xa0 c d e", "w " * 5000])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode(), 4) & (1 << 64) - 1 == plain_print(text)


@pytest.mark.parametrize("radius", range(8))
def test_balls_miss_nothing(radius):
    rnd = random.Random(radius)
    for _ in range(300):
        mask = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any((mask >> at & (1 << bits) - 1).bit_count() <= r for at, bits, r in segments(radius))
    assert len(ball(21, 1)) == 22 and len(set(ball(9, 2))) == 1 + 9 + 36


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("scheme", SCHEMES)
@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_tables_miss_nothing(scheme, radius):
    rnd = random.Random(radius)
    held = tables(radius, scheme)
    for _ in range(400):
        mask = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(sum((mask >> at & (1 << bits) - 1).bit_count() for at, bits in parts) <= near for parts, near in held)


def test_keys_grow_with_the_input():
    assert scheme_for(0) == scheme_for(10**7) == (3, 1) and scheme_for(10**8) == (5, 2) and scheme_for(10**10) == (6, 3)
    for n in (10**6, 10**8, 3 * 10**10):
        bits = sum(bits for _, bits in tables(4, scheme_for(n))[0][0])
        assert n / 2**bits <= 8


# Blocks and points for small buckets too, and both at once.
@pytest.mark.parametrize(("scheme", "crowded", "block", "half"), [(s, 32, 4096, None) for s in SCHEMES] + [(SCHEMES[0], 3, 7, None), (SCHEMES[1], 3, 7, 3), (SCHEMES[0], 1, 2, 4)])
def test_links_reach_as_far_as_brute_force(spark, monkeypatch, scheme, crowded, block, half):
    from hopforge.llm import simhash

    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "BLOCK", block)
    if half:  # the points are taken as so few that most crowded buckets go through them
        class Few(list):
            def __len__(self):
                return half

        plain = simhash.ball
        monkeypatch.setattr(simhash, "ball", lambda bits, radius: Few(plain(bits, radius)) if bits == 64 else plain(bits, radius))
    rnd = random.Random(11)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        center = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 80])):
            prints.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 6))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "f long")
    roots = {r.node: r.root for r in components(_links(frame, 4, scheme)).collect()}
    want = brute_components(prints, [signed(p) for p in prints])
    assert [roots.get(signed(p), signed(p)) for p in prints] == want


def test_spanning_forest_is_small():
    prints = np.array([1 << i for i in range(60)], np.uint64)
    assert len(spanning_forest(prints, 4)) == 59
    assert spanning_forest(prints[:1], 4) == [] == spanning_forest(prints[:0], 4)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 400)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(101, 161)) and all(found[i] == 7 for i in range(200, 400))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    long = " ".join(f"word{i}" for i in range(400))
    docs = [(9, long), (3, long + " more"), (4, long), (4, long), (1, None), (2, ""), (None, "lonely words stand here alone"), (8, "x " * 50_000)]
    rows = near_duplicates(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, f string")).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((d is None, d) for d, _ in docs)
    got = {r.doc_id: r.component_id for r in rows}
    known = [d for d in docs if d[0] is not None]
    want = brute_components([plain_print(t) for _, t in known], [d for d, _ in known])
    assert [got[d] for d, _ in known] == want and got[None] is None
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_of_each_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(5, text, "a"), (2, text, "b"), (2, text, "c"), (7, "other text altogether, not alike at all", "d")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in keep_first_of_each(docs).collect()) == [2, 7]


def test_query_against_brute_force(spark):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()
    prints = [plain_print(t) for _, t in docs]
    want = {d: (f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, brute_components(prints, [d for d, _ in docs]), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op3_multi_index(spark, "/root/testdata/sf0.001").collect()} == want


def test_different_texts_of_one_id_stay(spark):
    texts = [" ".join(f"{x}{i}" for i in range(100)) for x in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " more"), (4, texts[2]), (4, texts[3]), (4, texts[3]), (3, texts[0] + " more"), (5, None)]
    got = keep_first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 4 for r in got) == 2
    assert sorted(r.doc_id for r in got if r.doc_id) == [3, 4, 4, 5]
    # Null and empty texts have no words and are copies.
    assert keep_first_of_each(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).count() == 1
