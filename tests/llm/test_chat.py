import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from hopforge.llm.chat import OP2_SQL, escape, format_conversations, op2_template_compiler, read_back, unescape
from hopforge.llm.template import Template, TemplateError, const, fold, parse


def render(source, **names):
    return Template(source).text(**names)


@pytest.mark.parametrize(
    ("source", "names", "want"),
    [
        ("plain {# not this #}text", {}, "plain text"),
        ("{{ 'a' ~ 1 + 2 }}|{{ 1 + 2 }}", {}, "a12|3"),
        ("{% if x %}yes{% elif y == 'b' %}maybe{% else %}no{% endif %}", {"y": "b"}, "maybe"),
        ("{% for m in ms %}{{ loop.index }}{{ m.a['b'] }}{% if not loop.first %},{% endif %}{% endfor %}", {"ms": [{"a": {"b": 1}}, {"a": {}}]}, "112,"),
        ("{% set n = name | trim | upper %}{{ n }}{{ n | length }}", {"name": " ab "}, "AB2"),
        (" a {%- if true -%} b {%- endif -%} c", {}, " abc"),
        ("{{ 'x' in 'xyz' and 3 > 2 and not false }}", {}, "True"),
        ("{{ xs[1] }}{{ xs[9] }}{{ missing.a.b }}", {"xs": ["p", "q"]}, "q"),
        (r"{{ 'it\'s\n' }}", {}, "it's\n"),
        ("{{ '}}' }}{{ \"%}\" ~ '{{' }}", {}, "}}%}{{"),
        ("{% if x == '%}' %}a{% endif %}{% set y = '-}}' -%} {{ y }}", {"x": "%}"}, "a-}}"),
        ("it's {{ x }} and it's", {"x": "so"}, "it's so and it's"),
    ],
)
def test_language(source, names, want):
    assert render(source, **names) == want


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ (1).real }}", "{{ ''.join }}"])
def test_sandbox_sees_no_attributes(source):
    try:
        assert render(source, x=[]) == ""
    except TemplateError:
        pass


@pytest.mark.parametrize("source", ["{{ __import__ }}", "{% import os %}", "{{ f(1) }}", "{{ x | eval }}", "{% for x in y %}", "{{ 1 + }}", "{% if %}{% endif %}", "{{ a ; b }}", "{{ 'open }}", "{{ 'open }} {{ x }}", "{% if 'open %}{% endif %}"])
def test_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' ~ 1 }}{% if 1 > 2 %}never{% else %}{{ 'c' | upper }}{% endif %}{{ x }}"))
    assert tree.parts[0].parts[0] == const("ab1C") and [p.kind for p in tree.parts] == ["write", "write"]


def test_loops_are_lazy():
    seen = []

    def endless():
        for i in range(10**9):
            seen.append(i)
            yield {"v": i}

    class Enough(Exception):
        pass

    def sink(text, marked):
        if len(seen) > 3:
            raise Enough

    with pytest.raises(Enough):
        Template("{% for m in ms %}{{ m.v }}{% endfor %}").render({"ms": endless()}, sink)
    assert len(seen) == 4


@given(st.text(alphabet="\\<|>tend a\n"))
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert "<|" not in re.sub(r"\\.", "__", escape(text), flags=re.S)


def digests(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:5] for r in df.collect()}


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_round_trip(spark, piece):
    rnd = random.Random(piece)
    parts = ["\\", "<", "|", "<|turn|>", "<|end|>\n", "\n", "text", "é", "### Assistant: ", "</turn>"]
    rows = [(c, t, rnd.choice(["user", "assistant", "a<|b\\", None]), rnd.choice([None, "", "".join(rnd.choices(parts, k=8))])) for c in range(60) for t in range(rnd.randrange(1, 5))]
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (7, 0, "assistant", "tie"), (7, None, "user", "no turn"), (99, 0, "assistant", "long " * 3000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    assert got(read_back(format_conversations(frame, piece=piece))) == digests(rows)


def test_other_templates_and_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_conversations(empty)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "r")], empty.schema)
    out = format_conversations(rows, "{{ 'bos' }}{% for m in messages %}{{ m.role }}:{% generation %}{{ m.content }}{% endgeneration %};{% endfor %}").collect()
    assert sorted((r.conv_id, r.text, [(m.start, m.end) for m in r.marks]) for r in out) == [(1, "bosuser:q;assistant:a;", [(8, 9), (20, 21)]), (2, "bosuser:r;", [(8, 9)])]
    assert {r.text for r in format_conversations(rows, "same").collect()} == {"same"}


def test_query(spark):
    rows = duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    tricky = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    assert got(op2_template_compiler(spark, "/root/testdata/sf0.01")) == digests(rows)


def test_query_equals_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    assert sorted(map(tuple, op2_template_compiler(spark, "/root/testdata/sf0.01").collect())) == sorted(duckdb.sql(OP2_SQL).fetchall())
