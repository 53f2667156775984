import random

import duckdb
import numpy as np
import pytest

from hopforge.llm.line_dedup import OP5_SQL, LineIndex, PerfectHash, drop_repeated_lines, op5_perfect_hash_lines

BLANKS = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=3, chars=20):
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= chars:
                holders.setdefault(key, set()).add(-(1 << 63) if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        me = -(1 << 63) if i is None else i
        kept = [x for x in lines if len(h := holders.get(x.strip(BLANKS).translate(LOWER), ())) < least or max(h) == me]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=repr)


def test_perfect_hash_is_minimal():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 30_000):
        a, b = (rnd.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        assert sorted(PerfectHash(a, b).index(a, b).tolist()) == list(range(n))
    a, b = np.zeros(50, np.uint64), np.arange(50).astype(np.uint64)
    assert sorted(PerfectHash(a, b).index(a, b).tolist()) == list(range(50))


@pytest.mark.parametrize("stored", [False, True])
def test_index_counts_and_refuses_strangers(stored):
    keep = (lambda x: LineIndex.unpacked(x.packed())) if stored else (lambda x: x)
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    count, last = np.arange(5000) + 3, np.arange(5000) * 7
    index = keep(LineIndex(a, b, count, last))
    got = index.probe(a, b)
    assert got[0].tolist() == count.tolist() and got[1].tolist() == last.tolist()
    # A stranger that shares the first half of its hash, or none of it, may fall on another line's place.
    assert not index.probe(a, b + np.uint64(1))[0].any()
    c, d = rnd.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    assert (index.hash.index(c, d) >= 0).sum() > 3000 and not index.probe(c, d)[0].any()
    none = keep(LineIndex(a[:0], b[:0], np.zeros(0, int), np.zeros(0, int)))
    assert none.probe(a[:3], b[:3])[0].tolist() == [0, 0, 0]


def test_documents_ask_the_arrays(spark, monkeypatch):
    """Without the fingerprints' refusal strangers take other lines' counts: the query's answers come from the arrays."""
    rows = [(i, f"a line that all of them hold\nand one of its own, number {i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.n_dropped for r in drop_repeated_lines(frame).collect()) == [0] + [1] * 39

    def careless(self, a, b):
        at = self.hash.index(a, b)
        return np.where(at >= 0, self.count[at], 0), np.where(at >= 0, self.last[at], -1)

    monkeypatch.setattr(LineIndex, "probe", careless)
    assert sum(r.n_dropped for r in drop_repeated_lines(frame).collect()) > 39


def test_small_shards_blocks_and_turns(spark, monkeypatch):
    from hopforge.llm import line_dedup as L

    for name, value in (("BLOCK_BYTES", 200), ("SHARD_BYTES", 700), ("BLOCKS_PER_TURN", 4)):
        monkeypatch.setattr(L, name, value)
    rnd = random.Random(8)
    pool = [f"A line that is long enough {i}" for i in range(30)]
    docs = [(rnd.choice([i, i, None, 4]), "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 9)))) for i in range(80)]
    assert got(drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_against_brute_force(spark):
    rnd = random.Random(7)
    pool = [f"A line that is long enough {i}" for i in range(12)] + ["short", "", "  padded line that is LONG enough\t", "Padded line that is long ENOUGH", "ä" * 19, "ä" * 20, "\x1cline of 20 chars ok", "line of 20 chars ok\x1c"]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 9)))) for i in range(60)]
    docs += [(None, pool[0]), (None, pool[0]), (5, pool[1]), (5, pool[1]), (70, None), (71, ""), (-3, pool[0] + "\n" + "x" * 300_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(drop_repeated_lines(frame)) == brute(docs)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_lines(empty).count() == 0
    rows = spark.createDataFrame([(1, "t", 3, "x", 9, 1, 2)], "doc_id long, text string, Block long, n_lines string, shard long, a long, last long")
    out = drop_repeated_lines(rows)
    assert out.columns == ["doc_id", "text", "Block", "shard", "a", "last", "n_lines", "n_dropped"]
    assert out.first().Block == 3


def test_null_text_stays_null(spark):
    rows = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert drop_repeated_lines(rows).first().text is None


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
    want = sorted(duckdb.sql(OP5_SQL).fetchall())
    assert sorted(map(tuple, op5_perfect_hash_lines(spark, f"/root/testdata/sf{sf}").collect())) == want
