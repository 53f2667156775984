import random

import duckdb
import numpy as np
import pytest

from hopforge.llm.decontamination import BenchmarkIndex, banded_edits, codes, drop_leaks, find_leaks, grams, normalised, op8_q_gram_lemma


def edits_inside(pattern, text):
    """Fewest edits between pattern and any part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(60))
def test_banded_alignment(seed):
    rnd = random.Random(seed)
    p = "".join(rnd.choices("ab", k=rnd.randrange(1, 12)))
    t = "".join(rnd.choices("ab", k=rnd.randrange(0, 15)))
    best = edits_inside(p, t)
    found = banded_edits(codes(p), codes(t), -len(p), len(t), len(p))
    assert found[0] == best and edits_inside(p, t[: found[1]]) == best
    assert banded_edits(codes(p), codes(t), -len(p), len(t), best - 1) is None


def test_grams_tell_apart():
    c = codes("abcabcabdabc")
    for q in (1, 3, 7, 8, 12):
        g = grams(c, q).tolist()
        assert len(g) == len(c) - q + 1
        assert all((g[i] == g[j]) == (c[i : i + q].tolist() == c[j : j + q].tolist()) for i in range(len(g)) for j in range(len(g)))
    assert len(grams(c, 13)) == 0


def brute(docs, items, rate=0.1, q=8):
    out = set()
    for place, text in enumerate(docs):
        for item, b in items:
            b = normalised(b)
            if len(b) >= q and edits_inside(b, text) <= min(int(len(b) * rate), (len(b) - q) // q):
                out.add((place, item))
    return out


def test_lemma_loses_nothing():
    rnd = random.Random(8)
    letters = "abcdefg  "
    items = [(i, "".join(rnd.choices(letters, k=rnd.randrange(4, 120)))) for i in range(25)]
    docs = []
    for _ in range(60):
        s = list(normalised(items[rnd.randrange(25)][1]))
        for _ in range(rnd.randrange(0, max(1, len(s) // 7) + 1)):
            at = rnd.randrange(len(s) + 1)
            s[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "yy"])
        docs.append(normalised("".join(rnd.choices(letters, k=80)) + "".join(s) + "".join(rnd.choices(letters, k=80))))
    index = BenchmarkIndex(items)
    assert {(p, i) for p, i, *_ in index.find(docs)} == brute(docs, items)
    assert {(p, i) for p, i, *_ in index.find(docs * 3)} == {(p + 60 * k, i) for p, i in brute(docs, items) for k in range(3)}


def test_repeats_within_a_text_and_many_portions(monkeypatch):
    from hopforge.llm import decontamination as D

    monkeypatch.setattr(D, "PORTION", 50)
    monkeypatch.setattr(D, "STRETCH", 300)
    items = [(1, "a" * 60), (2, "the quick brown fox jumps over the lazy dog again and again")]
    docs = ["a" * 500, "a" * 59 + "b" + "a" * 200, "b" * 700 + " the quick brown fox jumps over the lazy dog again and again " + "c" * 350, "ab" * 200]
    assert {(p, i) for p, i, *_ in BenchmarkIndex(items).find(docs)} == {(0, 1), (1, 1), (2, 2)}


def test_long_items_are_found_in_part():
    rnd = random.Random(2)
    item = " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(100))
    found = list(BenchmarkIndex([(4, item)]).find(["zz " + item[100:320] + " zz", "zz " + item[100:160] + " zz"]))
    assert [(p, i) for p, i, *_ in found] == [(0, 4)]


def test_rows(spark):
    text = "What is the capital of the country, that lies to the north? It is not known."
    items = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (4, ""), (5, "tiny"), (None, "a null id has this quite long text of its own")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "x " + text.upper() + " y", 1), (10, "x " + text.upper() + " y", 1), (None, text, 2), (11, "clean " * 20_000, 3), (12, None, 4), (13, "", 5)], "doc_id long, text string, start int")
    rows = sorted(((r.doc_id, r.item_id, r.edits) for r in find_leaks(docs, items).collect()), key=repr)
    assert rows == sorted([(10, 1, 0), (10, 2, 0)] * 2 + [(None, 1, 0), (None, 2, 0)], key=repr)
    assert sorted(r.doc_id for r in drop_leaks(docs, items).collect()) == [11, 12, 13]
    none = spark.createDataFrame([], items.schema)
    assert find_leaks(docs, none).count() == 0 and find_leaks(spark.createDataFrame([], docs.schema), items).count() == 0
    own = spark.createDataFrame([(20, "a null id has this quite long text of its own")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in find_leaks(own, items).collect()] == [(20, None)]


def test_rows_are_dropped_by_text_and_not_by_id(spark):
    text = "What is the capital of the country, that lies to the north? It is not known."
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = [(None, text, "a"), (None, "clean", "b"), (None, None, "c"), (7, "x " + text, "d"), (7, "clean too", "e"), (7, "clean too", "e")]
    out = drop_leaks(spark.createDataFrame(docs, "doc_id long, text string, Item_Id string"), items)
    assert out.columns == ["doc_id", "text", "Item_Id"] and sorted(r.Item_Id for r in out.collect()) == ["b", "c", "e", "e"]


def test_benchmark_in_blocks(spark, monkeypatch):
    from hopforge.llm import decontamination as D

    monkeypatch.setattr(D, "BENCHMARK_CHARS", 60)
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(6)) for _ in range(12)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so {t} it is") for i, t in enumerate(texts)] + [(50, "clean")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()) == [(i, i) for i in range(12)]
    assert [r.doc_id for r in drop_leaks(docs, items).collect()] == [50]


def test_query_against_exact_search(spark):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    items = [(i, normalised(t)) for i, t in duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.01/benchmark.parquet'").fetchall()]
    want = {(d, i) for d, t in docs for n in [normalised(t)] for i, b in items if b in n}
    rows = op8_q_gram_lemma(spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.edits == 0 and (r.doc_id, r.item_id) in want} == want
    assert np.mean([(r.doc_id, r.item_id) in want for r in rows]) > 0.9


def test_items_little_longer_than_a_segment(spark):
    item = "the seven grey ships that left the harbour before dawn had all come back again by the end of that same week"
    docs = spark.createDataFrame([(1, "so " + item[:100] + " but not the rest of it")], "doc_id long, text string")
    assert len(item) > 100 and [r.doc_id for r in find_leaks(docs, spark.createDataFrame([(3, item + " it seems")], "item_id long, text string")).collect()] == [1]


@pytest.mark.parametrize("size", [130, 240, 299, 330, 700])
def test_excerpts_are_found(size):
    rnd = random.Random(size)
    text = lambda n: normalised(" ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 9))) for _ in range(n)))[:n]
    item = text(size).strip().ljust(size, "z")
    index = BenchmarkIndex([(7, item)])
    starts = sorted({0, (size - 124) // 2, (size - 124) // 3, size - 124})
    docs = [text(300) + " " + item[i : i + 124] + " " + text(300) for i in starts] + [text(700)]
    # All but a few characters of the shortest are the whole of it with edits.
    assert [(p, i, size > 130 and e) for p, i, _, _, e in index.find(docs)] == [(p, 7, 0) for p in range(len(starts))]
    if size <= 300:  # a whole item goes before a better segment
        edited = item[:5] + "#" + item[6:]
        doc, _, start, end, edits = next(index.find([text(50) + " " + edited + " " + text(50)]))
        assert (edits, end - start) == (1, size)
