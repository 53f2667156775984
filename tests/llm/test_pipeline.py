import random

import numpy as np
import pytest

import corpus_pipeline as P
from hopforge.llm.decontamination import normalised
from hopforge.llm.simhash import near_copies

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        before, docs = docs, P.stored(stage(spark, docs, SF))[0]
        out.append((before, docs))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.where("n_chars <> length(text)").count() == 0


def test_quality_stage(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[0])
    assert set(after) < set(before)
    assert all(len((t or "").split()) < 50 or d in after or (t or "").count("***") > 3 or len(set(t.split())) < len(t.split()) for d, t in before.items())


def test_line_stage(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[1])
    assert set(after) == set(before)
    holders = {}
    for d, t in after.items():
        for line in {x.strip().lower() for x in t.split("\n") if len(x.strip()) >= 20}:
            holders.setdefault(line, set()).add(d)
    often = {}
    for d, t in before.items():
        for line in {x.strip().lower() for x in t.split("\n") if len(x.strip()) >= 20}:
            often.setdefault(line, set()).add(d)
    assert all(len(holders.get(x, ())) == 1 for x, h in often.items() if len(h) >= 3)


def test_near_copies_leave_one(stages):
    before, after = ([r for r in df.collect()] for df in stages[2])
    texts = {r.text for r in after}
    assert texts <= {r.text for r in before}
    assert len(after) == len({r.doc_id for r in after}) and len([r for r in after if r.text == ""]) <= 1


def test_no_leak_is_left(spark, stages):
    items = [normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [normalised(r.text) for r in stages[3][1].collect()]
    assert not any(b in t for b in items for t in left)


def test_no_row_goes_for_another_ones_id(spark):
    """Several rows without an id and several texts of one id, through the stages that drop rows."""
    rnd = random.Random(11)
    text = lambda k: " ".join(f"{rnd.choice('abcdefgh')}{k}x{i}" for i in range(120))
    a, b, c, d = (text(k) for k in range(4))
    docs = [(None, a), (None, b), (None, c), (7, a + " more"), (8, b + " more"), (8, d), (9, d), (9, "short")]
    frame = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        frame = P.stored(stage(spark, frame, SF))[0]
    assert sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr) == sorted([(None, c), (7, a + " more"), (8, b + " more"), (8, d)], key=repr)


def test_packing_packs_all(stages):
    before, after = stages[4]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def test_run_equals_the_stages(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert rows(P.run(spark, SF)) == rows(stages[4][1])


def test_near_copies_are_caught_and_others_left(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 9))) for _ in range(3000)]
    docs, pairs = [], []
    for i in range(120):
        w = rnd.choices(words, k=rnd.randrange(100, 600))
        v = [rnd.choice(words) if rnd.random() < 0.01 else x for x in w]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        pairs.append((2 * i, 2 * i + 1))
        rnd.shuffle(w)
        docs.append((1000 + i, " ".join(w)))  # the same words in another order
    docs += [(5000, None), (5001, ""), (None, "some words on their own")]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, g int, node int")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 100
    assert all(got[1000 + i] == 1000 + i for i in range(120)) and all(got[a] == a for a, _ in pairs)
    assert got[5000] == got[5001] == 5000 and got[None] is None
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("low, high, linked", [(0.8, 0.84, 1), (0.7, 0.795, 0)])
def test_near_copies_follow_the_exact_similarity(spark, low, high, linked):
    rnd = random.Random(21)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 9))) for _ in range(3000)]
    docs = []
    while len(docs) < 400:
        w = rnd.choices(words, k=rnd.randrange(100, 500))
        v = [rnd.choice(words) if rnd.random() < rnd.choice([0.02, 0.03, 0.04]) else x for x in w]
        if low <= jaccard(" ".join(w), " ".join(v)) <= high:
            docs += [(len(docs), " ".join(w)), (len(docs) + 1, " ".join(v))]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    together = sum(got[i] == got[i + 1] for i in range(0, 400, 2))
    assert together >= 196 if linked else together == 0


def test_large_groups_of_near_copies_are_linked_in_blocks(spark, monkeypatch):
    from hopforge.llm import simhash

    monkeypatch.setattr(simhash, "SETS", 50)
    rnd = random.Random(4)
    w = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(w[:at] + [f"new{i}"] + w[at + 1 :])) for i in range(300) for at in [rnd.randrange(200)]]
    assert {r.component_id for r in near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {0}


@pytest.mark.parametrize("block", [4096, 7])
def test_fingerprints_of_one_table_and_few_bits_apart_are_close(spark, monkeypatch, block):
    from hopforge.llm import simhash
    from hopforge.llm.components import components

    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(8)
    bits, count, radius = simhash.search_for(1000, 0.8)
    assert (bits, count, radius) == (12, 36, 34) and simhash.search_for(10**8, 0.8)[0] > 12
    nodes = []
    for _ in range(12):
        center = [rnd.random() < 0.5 for _ in range(448)]
        for _ in range(rnd.choice([1, 2, 30])):
            f = np.array([x ^ (rnd.random() < 0.15) for x in center])
            p, q = (int(np.packbits(f[at : at + 64], bitorder="little").view("<i8")[0]) for at in (0, 64))
            nodes.append((len(nodes), simhash.table_keys(f, bits, count).tolist(), p, q))
    root = list(range(len(nodes)))
    for i, (_, keys, p, q) in enumerate(nodes):
        for j, (_, others, r, s) in enumerate(nodes[:i]):
            if set(keys) & set(others) and sum((x & (1 << 64) - 1).bit_count() for x in (p ^ r, q ^ s)) <= radius and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert len(set(root)) < len(root) / 2
    frame = spark.createDataFrame(nodes, "node long, keys array<long>, p long, q long")
    found = {r.node: r.root for r in components(simhash._close(frame, radius)).collect()}
    assert [found.get(i, i) for i in range(len(nodes))] == root


def test_near_dedup_searches_by_simhash(spark, monkeypatch):
    """Texts are found through their fingerprints, and through nothing beside them."""
    from hopforge.llm import simhash

    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")
    kept = lambda: [r.doc_id for r in P.near_dedup(spark, docs, SF).collect()]
    assert kept() == [1]
    monkeypatch.setattr(simhash, "long_fingerprint", lambda hashes, words: np.random.default_rng(len(hashes)).random(64 * words) < 0.5)
    assert sorted(kept()) == [1, 2]


@pytest.mark.parametrize("kind", ["block", "end", "short"])
def test_near_copies_of_other_edits_are_found(spark, kind):
    rnd = random.Random(kind)
    new = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}" for _ in range(n)]
    docs = []
    while len(docs) < 400:
        w = new(rnd.randrange(12, 30) if kind == "short" else rnd.randrange(100, 400))
        at, n = rnd.randrange(len(w)), int(len(w) * rnd.uniform(0.05, 0.12))
        v = w[:at] + new(n) + w[at + n :] if kind == "block" else w + new(rnd.randrange(1, 4) if kind == "short" else 2 * n)
        if 0.8 <= jaccard(" ".join(w), " ".join(v)) <= 0.84:
            docs += [(len(docs), " ".join(w)), (len(docs) + 1, " ".join(v))]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 400, 2)) >= (180 if kind == "short" else 196)


def test_fewer_links_connect_the_same(spark):
    from hopforge.llm.components import components
    from hopforge.llm.simhash import _fewer

    rnd = random.Random(2)
    pairs = [(x, c) for x in range(100, 400) for c in rnd.sample(range(6), 4)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(80)]
    links = spark.createDataFrame([p if rnd.random() < 0.5 else p[::-1] for p in pairs if p[0] != p[1]], "a long, b long")
    fewer = _fewer(links)
    roots = lambda df: {r.node: r.root for r in components(df).collect()}
    assert fewer.where("a < 1000").count() <= 300 + 15
    assert roots(fewer) == roots(links)
