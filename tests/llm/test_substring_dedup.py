import random
import re

import duckdb
import numpy as np
import pytest

from hopforge.llm.substring_dedup import OP9_SQL, op9_count_min, remove_repeated_windows, rolled, sliding_min


def brute(docs, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    ids = [-(1 << 63) if d is None else d for d, _ in docs]
    first = {}
    for d, w in zip(ids, words, strict=True):
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), me, w in zip(docs, ids, words, strict=True):
        gone = {p for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < me for p in range(i, i + n)}
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=repr)


def test_rolling_and_minimum():
    rnd = np.random.default_rng(1)
    w = rnd.integers(0, 1 << 60, 90).astype(np.uint64)
    for n in (1, 2, 3, 16, 50, 90):
        want = [sum(int(x) * pow(31, n - 1 - k, 1 << 64) for k, x in enumerate(w[i : i + n])) % (1 << 64) for i in range(len(w) - n + 1)]
        assert rolled(w, 31, n).tolist() == want
        assert sliding_min(w, n).tolist() == [min(w[i : i + n].tolist()) for i in range(len(w) - n + 1)]


def test_against_brute_force(spark):
    rnd = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(rnd.randrange(8, 40))] for k in range(6)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(rnd.randrange(0, 6)):
            w += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice("abcdefgh") for _ in range(rnd.randrange(12))]
            if w and rnd.random() < 0.4:
                w[rnd.randrange(len(w))] = "changed"
        docs.append((d, rnd.choice([" ", "\n", "\t "]).join(w)))
    docs += [(7, docs[7][1]), (None, " ".join(passages[0])), (None, " ".join(passages[0])), (100, None), (101, ""), (102, "one"), (103, " ".join(["same"] * 3000))]
    docs += [(104, " ".join(["same"] * 200)), (-5, "\x1c".join(passages[1]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(remove_repeated_windows(frame, window=10, gram=4)) == brute(docs, 10)


def test_empty_table_and_clashing_columns(spark):
    assert remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "t", 3, 4, 5)], "doc_id long, text string, block long, n_words int, first int")
    assert remove_repeated_windows(rows).columns == ["doc_id", "text", "block", "first", "n_words", "n_removed"]


def test_exact_copies_and_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    rows = got(remove_repeated_windows(spark.createDataFrame([(1, text), (2, text), (3, "tail " + text)], "doc_id long, text string")))
    assert [r[2] for r in rows] == [0, 300_000, 300_000] and rows[2][3] == "tail"


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
    want = sorted(duckdb.sql(OP9_SQL).fetchall())
    assert sorted(map(tuple, op9_count_min(spark, f"/root/testdata/sf{sf}").collect())) == want


def test_sketch_keeps_its_filter_at_any_size():
    """Of keys that never repeat few pass, however many there are; of repeated ones none is lost."""
    from hopforge.llm import substring_dedup as S

    rnd = np.random.default_rng(4)
    for shards in (1, 7, 40):
        width = 4000
        # As many keys a cell as prose has: one in 140 bytes, a cell in CELL_BYTES.
        n = int(shards * width * S.CELL_BYTES / 140)
        single, double = rnd.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        double = double[: n // 20]
        blocks = [np.concatenate([x, double]) for x in np.array_split(single, 9)]
        sketches = [S.block_sketch(np.zeros(len(b), np.int64), b, shards, width) for b in blocks]
        often = [np.zeros(len(at), bool) for at, _ in sketches]
        for s in range(shards):
            mine = [[(lo, hi) for x, lo, hi in S.by_shard(at) if x == s] for at, _ in sketches]
            parts = [(i, *m[0]) for i, m in enumerate(mine) if m]
            packed = [((sketches[i][0][lo:hi] & np.uint64(0xFFFFFFFF)) << np.uint64(1) | sketches[i][1][lo:hi]).astype("<u4").tobytes() for i, lo, hi in parts]
            for (i, lo, hi), bits in zip(parts, S.merged_cells(packed), strict=True):
                often[i][lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo, bitorder="little")
        passed = [S.estimated_repeated(b, at, o, shards, width) for b, (at, _), o in zip(blocks, sketches, often, strict=True)]
        assert all(p[len(p) - len(double) :].all() for p in passed)
        alone = np.concatenate([p[: len(p) - len(double)] for p in passed])
        assert alone.mean() < 0.01


def test_small_shards_and_blocks_and_one_id_for_all(spark, monkeypatch):
    from hopforge.llm import substring_dedup as S

    for name, value in (("BLOCK_BYTES", 300), ("SKETCH_BYTES", 900), ("SHARD_BYTES", 500), ("WIDTH", 64)):
        monkeypatch.setattr(S, name, value)
    rnd = random.Random(6)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(4)]
    docs = [(rnd.choice([d, None, 3]), rnd.choice(passages) + f" u{d} " + rnd.choice(passages)) for d in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(remove_repeated_windows(frame, window=10, gram=4)) == brute(docs, 10)
