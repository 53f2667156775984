"""Chat formatting with a compiled template.

Conversations are dealt by id and sorted by turn, and each streams through the
template: a piece of output leaves as soon as it is long enough, so the
longest conversation needs no more memory than a short one. Reading back finds
turns and marked text in the output alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.llm.support import table
from hopforge.llm.template import Template

#: Control strings start with OPEN; inside texts it gets a backslash, as does a backslash.
OPEN = "<|"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TEMPLATE = (
    "{% for message in messages %}<|turn|>{{ message.role | escape }}<|text|>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{% else %}{{ message.content | escape }}{% endif %}<|end|>\n{% endfor %}"
)
#: Code points per row of output.
PIECE = 1 << 20


def escape(text: object) -> str:
    return ("" if text is None else str(text)).replace("\\", "\\\\").replace(OPEN, "\\" + OPEN)


def unescape(text: str) -> str:
    """The inverse of escape: a backslash stands before the character it keeps."""
    if "\\" not in text:
        return text
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\", "") for p in parts)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, piece: int = PIECE) -> DataFrame:
    """Rows (conv_id, part, text, marks), sorted by conv_id and part inside partitions.

    conversations has conv_id (long), turn (long), role and text (strings).
    The texts of a conversation's parts, joined, are its formatted text. marks
    lists (start, end) of generated text within the part, in code points.

    Turns are ordered by turn, ties by role and then text; repeated rows are
    turns each. A null role or text is empty; null turns come first; a null
    conv_id is a conversation of its own. An empty table gives an empty table;
    extra columns are left out.
    """
    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    dealt = conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        compiled = Template(template, {"escape": escape})
        rows = ((c, {"role": r, "content": t}) for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        done: list[tuple] = []
        ahead = next(rows, None)

        def messages(conv):
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                now, ahead = ahead[1], next(rows, None)
                yield now

        while ahead is not None:
            conv, part = ahead[0], 0
            out: list[str] = []
            marks: list[dict] = []
            size = 0

            def flush():
                nonlocal part, size
                done.append((conv, part, "".join(out), list(marks)))
                part, size = part + 1, 0
                out.clear()
                marks.clear()

            def sink(text: str, marked: bool):
                nonlocal size
                for i in range(0, len(text), piece):
                    some = text[i : i + piece]
                    if size and size + len(some) > piece:
                        flush()
                    if marked:
                        if marks and marks[-1]["end"] == size:
                            marks[-1]["end"] = size + len(some)
                        else:
                            marks.append({"start": size, "end": size + len(some)})
                    out.append(some)
                    size += len(some)

            stream = messages(conv)
            compiled.render({"messages": stream}, sink)
            for _ in stream:  # what the template left
                pass
            flush()
            if len(done) >= 1000 or sum(len(d[2]) for d in done[-4:]) > piece:
                yield _batch(done)
                done = []
        if done:
            yield _batch(done)

    return dealt.mapInArrow(run, "conv_id long, part long, text string, marks array<struct<start:long,end:long>>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "part", "text", "marks"])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    kinds = {"conv_id": long, "n_turns": long, "turns_sha256": text, "loss_chars": long, "loss_sha256": text, "formatted_chars": long}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


class Reader:
    """Reads formatted text back, part by part, and digests its turns and its marked text."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.held, self.marked = "", ""  # what can't be told yet

    def feed(self, text: str, marks: list[dict]) -> None:
        self.chars += len(text)
        for m in marks:
            self.marked = self._loss(self.marked + text[m["start"] : m["end"]])
        self.held = self._turn(self.held + text)

    def _loss(self, text: str) -> str:
        whole, rest = _before_odd_backslash(text)
        plain = unescape(whole)
        self.loss_chars += len(plain)
        self.loss.update(plain.encode())
        return rest

    def _turn(self, text: str) -> str:
        """Takes in all control strings and the text around them; returns what may be half of one."""
        at = 0
        while True:
            found, keep = _control(text, at)
            if found is None:
                cut, rest = _before_odd_backslash(text[at:keep])
                self.turns.update(unescape(cut).encode())
                return rest + text[keep:]
            start, word = found
            self.turns.update(unescape(text[at:start]).encode())
            if word == TURN:
                self.n_turns += 1
            else:
                self.turns.update(b"\n")
            at = start + len(word)

    def row(self, conv: int | None) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _before_odd_backslash(text: str) -> tuple[str, str]:
    """text without an escape that has begun at its end, and that escape."""
    n = len(text) - len(text.rstrip("\\"))
    return (text[:-1], text[-1:]) if n % 2 else (text, "")


def _control(text: str, at: int) -> tuple[tuple[int, str] | None, int]:
    """The next control string that isn't escaped; else where text must be kept from."""
    i = at
    while (i := text.find(OPEN, i)) >= 0:
        back = i
        while back > at and text[back - 1] == "\\":
            back -= 1
        if (i - back) % 2:
            i += 1
            continue
        for word in (TURN, TEXT, END):
            if text.startswith(word, i):
                return (i, word), 0
            if word.startswith(text[i:]):
                return None, i
        raise ValueError(f"no control string at {text[i : i + 20]!r}")
    return None, len(text) - text.endswith(OPEN[0])


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation with the digests of what the formatted text says."""

    def run(batches: Iterator[pa.RecordBatch]):
        current, reader, done = None, None, []
        for batch in batches:
            for conv, part, text, marks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part == 0:
                    if reader:
                        done.append(reader.row(current))
                    current, reader = conv, Reader()
                reader.feed(text, marks)
            if len(done) > 1000:
                yield _digests(done)
                done = []
        if reader:
            yield _digests([*done, reader.row(current)])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_template_compiler(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '\<|')) + length(replace(replace(text, '\', '\\'), '<|', '\<|')) AS chars FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|><|text|><|end|>') + 1 + chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
