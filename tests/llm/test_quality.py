import random
import re

import duckdb
import pytest

from hopforge.llm.quality import OP1_SQL, base_counts, keep_good_documents, line_hash, line_quality, op1_line_frequency

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(t):
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


@pytest.mark.parametrize("seed", range(30))
def test_base_counts(seed):
    rnd = random.Random(seed)
    t = "".join(rnd.choice(["a", "b ", "é", "\n", " ", "# ", "a b c ", "\x1c", "a b\n", "<|>"]) for _ in range(rnd.randrange(0, 60)))
    assert base_counts(t.encode()) == plain_counts(t)


def test_lines_are_normalised():
    assert line_hash(b"  Page 12  of 99\t") == line_hash(b"page 3 of 4") != line_hash(b"page of")
    assert line_hash(b" \t") is None


def letters(n):
    return "".join("abcdefghij"[int(c)] for c in str(n))


def body(i, n=80):
    return " ".join(f"word{letters(i)}x{letters(k)}" for k in range(n))


def test_template_lines_and_depleted_documents(spark):
    menu = " ".join(f"menu{letters(k)}" for k in range(100))
    docs = [(i, f"{body(i)}\nHome page {i} of all", "h1") for i in range(40)]
    docs += [(100 + i, f"{menu}\n{body(100 + i, 60)}", "h1") for i in range(40)]
    docs += [(200, f"{menu}\n{body(200)}", "h2"), (300, body(3, 49), "h1"), (301, "a b c " * 40, "h1"), (302, None, None), (303, "", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_quality(frame).collect()}
    assert all(got[i].kept and got[i].lost_words == 5 for i in range(40))
    assert not any(got[i].kept for i in range(100, 140)) and not got[101].base_failed
    assert got[200].kept  # another host
    assert all(got[i].base_failed and not got[i].kept for i in (300, 301, 302, 303))
    kept = {r.doc_id: r for r in keep_good_documents(frame.withColumn("n_chars", frame.doc_id)).collect()}
    assert set(kept) == {i for i, r in got.items() if r.kept}
    assert kept[5].text == body(5) and kept[5].n_chars == len(body(5)) and kept[0].text == body(0)


def test_copies_of_a_clean_document_stay(spark):
    docs = [(i, body(1) + "\n" + body(2), "h") for i in range(50)] + [(None, body(3), "h"), (None, body(3), "h")]
    got = line_quality(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(got) == 52 and all(r.kept for r in got)


def test_documents_are_counted_and_not_texts_or_rows(spark):
    line = "one line that many documents hold"
    # Twelve documents of eleven texts are over ten; eleven of ten texts aren't, nor are eleven rows of ten documents.
    a = [(i, f"{body(max(i, 1))}\n{line}", "a") for i in range(12)]
    b = [(100 + i, f"{body(100 + max(i, 1))}\n{line}", "b") for i in range(11)]
    c = [(200 + max(i, 1), f"{body(200 + max(i, 1))}\n{line}", "c") for i in range(11)]
    got = {(r.doc_id, r.lost_words) for r in line_quality(spark.createDataFrame(a + b + c, "doc_id long, text string, source string"), share=0.5).collect()}
    assert got == {(i, 6) for i in range(12)} | {(i, 0) for i, *_ in b + c}


def test_no_row_is_lost_for_its_id(spark):
    """Rows of one id, or of none, are judged each by their own host and text."""
    docs = [(None, body(1), "h", 1), (None, body(2), None, 1), (None, "short", "h", 1), (7, body(3), "h", 1), (7, "short", "h", 1), (7, body(3), "g", 1), (8, body(4), "h", 1), (8, body(4), "h", 1)]
    out = keep_good_documents(spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long"))
    assert sorted([(r.doc_id, r.text, r.source) for r in out.collect()], key=repr) == sorted([d[:3] for d in docs if d[1] != "short"], key=repr)


def test_empty_table_long_text_and_extra_columns(spark):
    assert line_quality(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    rows = spark.createDataFrame([(1, body(1, 200_000), "h", 1, 2, 3)], "doc_id long, text string, source string, n_chars long, row int, removed int")
    assert line_quality(rows).first().n_words == 200_000
    assert keep_good_documents(rows).columns == rows.columns and keep_good_documents(rows).count() == 1


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
    out = op1_line_frequency(spark, f"/root/testdata/sf{sf}")
    want = duckdb.sql(f"SELECT {', '.join(out.columns)} FROM ({OP1_SQL})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
