import random
import zlib

import duckdb
import numpy as np
import pytest

from hopforge.llm.packing import LevelArray, _encoder, last_share, op4_sum_of_squares, pack, pack_documents

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_sum_of_squares_rule():
    rnd = random.Random(3)
    width, levels, mine = 20, LevelArray(20), {}
    counts = [0] * 21
    for _ in range(500):
        size = rnd.randrange(1, 21)

        def after(h, size=size):
            c = list(counts)
            if h:
                c[h] -= 1
            if h + size < width:
                c[h + size] += 1
            return sum(x * x for x in c)

        best = min(after(h) for h in range(width - size + 1) if h == 0 or counts[h])
        window, at = levels.place(size)
        assert mine.get(window, 0) == at and after(at) == best
        if at:
            counts[at] -= 1
        if at + size < width:
            counts[at + size] += 1
        mine[window] = at + size


@pytest.mark.parametrize("n", [1, 2, 30, 1000, 10_000])
def test_pack_fills_windows(n):
    rnd = random.Random(4)
    sizes = [rnd.randrange(1, 1024) for _ in range(n)]
    whole = int(n * (1 - last_share(n)))
    got, by, levels = pack(sizes, 1024, whole), {}, LevelArray(1024)
    parts: dict[int, list] = {}
    for i, start, length, w, o in got:
        by.setdefault(w, []).append((o, length))
        parts.setdefault(i, []).append((start, length))
    for pieces in by.values():
        at = 0
        for o, length in sorted(pieces):
            assert o == at
            at += length
        assert at <= 1024
    for i, size in enumerate(sizes):
        at = 0
        for start, length in parts[i]:
            assert start == at
            at += length
        assert at == size and (i >= whole or len(parts[i]) == 1)
    # The rule places all before the last share, and most of that.
    ruled = [g for g in got if len(parts[g[0]]) == 1][: whole]
    assert [(w, o) for _, _, _, w, o in ruled] == [levels.place(x) for x in sizes[:whole]]
    assert sum(len(p) > 1 or i >= whole for i, p in parts.items()) <= n - whole
    assert 1024 * len(by) - sum(sizes) < 1024
    assert pack([], 8) == []


def test_encoder_equals_the_tokenizer(tokenizer):
    encode, rnd = _encoder(PATH), random.Random(1)
    pools = [range(32, 127), range(9, 14), range(0x80, 0x250), range(0x250, 0x600), range(0x2000, 0x2100), range(0x4E00, 0x4F00), range(0x1F600, 0x1F640), [32, 39, 115]]
    for _ in range(1500):
        t = "".join(chr(rnd.choice(rnd.choice(pools))) for _ in range(rnd.randrange(0, 25)))
        assert encode(t) == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    for t in ("a <|endoftext|> b", "", "<|endoftext|>", "퟿"):
        assert encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


def check(rows, docs, tokenizer, width=1024):
    ids = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in docs)
    assert sum(r.length for r in rows) == sum(map(len, ids))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(t)
    for d, held in texts.items():
        # Pieces of one id, each to the end of one of its texts.
        left = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in held]
        mine = [(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[d]]
        for whole in left:
            at = 0
            while at < len(whole):
                fits = next(m for m in mine if m[0] == at and m[3] == len(whole) and m[2] == zlib.crc32(np.array(whole[at : at + m[1]], "<u4").tobytes()))
                mine.remove(fits)
                at += fits[1]
        assert not mine
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width


def test_odd_documents(spark, tokenizer):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "lonely"), (None, None), (4, "word " * 40_000), (5, "x" * 5000), (6, "日本語 " * 500)]
    rows = pack_documents(spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, start int, packer int"), PATH, rests_per_packer=3).collect()
    check(rows, docs, tokenizer)
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, tokenizer):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    check(op4_sum_of_squares(spark, "/root/testdata/sf0.001").collect(), docs, tokenizer)
    sequences = len({r.sequence_id for r in op4_sum_of_squares(spark, "/root/testdata/sf0.01").collect()})
    tokens = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert sequences == -(-tokens // 1024)  # one packer: not a window too many


def test_placement_of_the_query_is_the_rules(spark):
    """Rests that aren't cut lie where the rule alone, run in plain Python over the same order, puts them."""
    rows = [r for r in op4_sum_of_squares(spark, "/root/testdata/sf0.001").collect() if r.length < 1024 and r.sequence_id % 2 == 0]
    whole = [r for r in rows if r.start % 1024 == 0 and (r.start + r.length == r.doc_tokens)]
    keys = spark.createDataFrame([(r.ids_crc32, r.doc_id) for r in whole], "c long, d long").selectExpr("c", "d", "xxhash64(c, d, 1) AS turn")
    turn = {(r.c, r.d): r.turn for r in keys.collect()}
    order = sorted(whole, key=lambda r: (turn[r.ids_crc32, r.doc_id], r.doc_id, r.ids_crc32))
    n = len(whole) + len({(r.doc_id) for r in rows} - {r.doc_id for r in whole})
    first = [r for r in order if turn[r.ids_crc32, r.doc_id] < int((1 - 2 * last_share(n)) * (1 << 63))]
    counts, opened, windows, fill = [0] * 1025, {}, 0, {}
    for r in first:
        best = None
        for h in range(0, 1024 - r.length + 1):
            if h and not counts[h]:
                continue
            c = counts[:]
            c[h] -= 1 if h else 0
            if h + r.length < 1024:
                c[h + r.length] += 1
            key = (sum(x * x for x in c), h == 0, h)
            if best is None or key < best[0]:
                best = (key, h, c)
        _, h, counts = best
        if h:
            w = opened[h].pop()
        else:
            w, windows = windows, windows + 1
        opened.setdefault(h + r.length, []).append(w)
        assert (r.sequence_id, r.offset) == (2 * w, h)
