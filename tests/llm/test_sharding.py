import random
import zlib

import duckdb
import pytest

from hopforge.llm.sharding import OP7_SQL, assign_shards, op7_sampled_splitters, shard_documents


def check(rows, docs):
    assert sorted((r.doc_id is None, r.doc_id, r.text_crc32) for r in rows) == sorted((i is None, i, zlib.crc32((t or "").encode())) for i, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    return by


def test_equal_bytes_and_whole_rows(spark):
    rnd = random.Random(1)
    docs = [(i, "x" * rnd.randrange(1, 200) + str(rnd.randrange(50))) for i in range(2000)]
    by = check(shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    sizes = [sum(r.size for r in by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 204


def test_matches_a_plain_running_sum(spark):
    docs = [(i, f"text {i % 70}" * (i % 13)) for i in range(500)]
    rows = shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()
    import hashlib

    keyed = sorted((hashlib.md5(t.encode()).hexdigest(), i, len(t.encode()) + 1) for i, t in docs)
    total, at, want = sum(z for *_, z in keyed), 0, {}
    for _, i, z in keyed:
        want[i] = min(4, (2 * at + z) * 5 // (2 * total))
        at += z
    assert {r.doc_id: r.shard for r in rows} == want


def test_hot_group_is_divided(spark):
    docs = [(i, "same text") for i in range(300)] + [(1000 + i, f"other {i}") for i in range(300)]
    by = check(shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert len(by) == 16 and max(sizes) <= 1.2 * min(sizes)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(None, "a"), (None, "a"), (3, ""), (3, "")], [(1, "x" * 100_000), (2, "y")]])
def test_odd_inputs(spark, docs):
    check(shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_clashing_columns_stay(spark):
    rows = spark.createDataFrame([("a", 1, 5, 6, 7, 8), (None, None, 1, 1, 1, 1)], "key string, size long, shard int, k int, z int, row int")
    out = assign_shards(rows, "key", "size", 2)
    assert sorted(out.columns) == sorted(["key", "size", "k", "z", "row", "shard", "slot"])
    assert out.count() == 2


def test_names_clash_in_any_case(spark):
    out = assign_shards(spark.createDataFrame([("a", 1, 5, 6), ("b", 2, 5, 6)], "key string, size long, SHARD int, Slot int"), "key", "size", 2)
    assert out.columns == ["key", "size", "shard", "slot"] and {r.shard for r in out.collect()} == {0, 1}


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    from hopforge.llm import sharding as S

    docs = [(i, f"text {i % 900}" * (i % 13)) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted((r.doc_id, r.shard, r.slot) for r in shard_documents(frame).collect())
    for name, value in (("COARSE", 2), ("FINE", 2), ("RANGE_ROWS", 40)):
        monkeypatch.setattr(S, name, value)
    held = []
    before = S._subdivided
    monkeypatch.setattr(S, "_subdivided", lambda *a: held.append(before(*a)) or held[0])
    assert sorted((r.doc_id, r.shard, r.slot) for r in shard_documents(frame).collect()) == plain
    sizes = [r[0] for r in held[0].groupBy("r", "part").count().select("count").collect()]
    assert len(sizes) > 40 and max(sizes) < 300


def test_query(spark):
    out = op7_sampled_splitters(spark, "/root/testdata/sf0.001")
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    check(out.collect(), docs)
    assert {r.law for r in out.select("law").distinct().collect()} == {"bytes"}


def test_query_equals_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert sorted(map(tuple, op7_sampled_splitters(spark, "/root/testdata/sf0.01").collect())) == sorted(duckdb.sql(OP7_SQL).fetchall())
