"""Quality rules with cross-document line frequency.

Lines are normalised and hashed. For each host the distinct documents that
hold a line are counted; lines above the host's limit are template lines and
are removed from all of its documents. A document that loses most of its words
is depleted and rejected, as is one that fails the base rules.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.llm.support import cut, fresh, small, table, texts

#: Characters that count as symbols. Fixed values.
SYMBOLS = b"#*$%&|<>"
#: Keys of template lines are dealt over so many parts of a join.
SALTS = 32
DIGITS = re.compile(rb"[0-9]+")

MARKS = "doc_id long, host string, copy long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,words:int>>"


def line_hash(line: bytes) -> int | None:
    """Hash of a line with blanks squeezed, ASCII letters in lower case and numbers as 0; None without words."""
    words = line.lower().split()
    return xxhash.xxh3_64_intdigest(DIGITS.sub(b"0", b" ".join(words))) - (1 << 63) if words else None


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows found twice or more in the text."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    w = np.fromiter((names.setdefault(x, len(names)) for x in words), np.int64, len(words))
    pairs = w[:-1] * len(names) + w[1:]
    if len(names) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, back, times = np.unique(pairs[:-1] * len(names) + w[2:], return_inverse=True, return_counts=True)
    often = times[back] > 1
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i : len(words) - 2 + i] |= often
    return int(inside.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    chars = len(b"".join(words).decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def line_quality(docs: DataFrame, id_column: str = "doc_id", host: str = "source", min_docs: int = 10, share: float = 0.05, depleted: float = 0.5) -> DataFrame:
    """A row per document: doc_id, row, host, copy, the base counts, base_failed, lost_words, kept and removed.

    A line's limit in a host is the larger of min_docs and ``share`` of the
    host's distinct documents. Lines that more documents hold go from all of
    them; only a line that min_docs different texts or fewer hold stays, since
    it is repeated by copies of a document and is no template. ``removed``
    lists the hashes of the lines to go; ``lost_words`` counts their words. A
    document is kept if it doesn't fail the base rules (under 50 words, or
    over half of its words in repeated 3-word windows) and doesn't lose over
    ``depleted`` of its words.

    Words are runs without ASCII blanks. A null or empty text has no words and
    fails. A null host is a host of its own. Rows of one doc_id are judged
    each and count as one document; rows without one count as one document a
    text. The verdict on a row depends on its host and text alone; ``copy`` is
    the text's hash. An empty table gives an empty table.
    """

    def mark(batches):
        for batch in small(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in texts(batch.column(3)):
                text = text or b""
                lines: dict[int, int] = {}
                for line in text.split(b"\n"):
                    if (h := line_hash(line)) is not None:
                        lines[h] = lines.get(h, 0) + len(line.split())
                found = (*base_counts(text), [{"h": h, "words": n} for h, n in lines.items()])
                for held, x in zip(out, found, strict=True):
                    held.append(x)
            kind = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, pa.int64()) for x in out[:5]], pa.array(out[5], kind)], names=["doc_id", "host", "copy", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    told = docs.select(F.col(id_column).cast("long").alias("doc_id"), _host(host).alias("host"), F.xxhash64("text").alias("copy"), "text")
    marked = cut(told.mapInArrow(mark, MARKS).withColumn("row", F.monotonically_increasing_id()))
    who = F.coalesce("doc_id", "copy").alias("who")
    hosts = marked.groupBy("host").agg(F.count_distinct(who).alias("docs")).select("host", F.greatest(F.lit(float(min_docs)), F.col("docs") * share).alias("limit"))
    lines = marked.select("row", who, "host", "copy", F.explode("lines").alias("l")).select("row", "who", "host", "copy", "l.h", "l.words")
    # Rows are at least as many as distinct documents, and counting them combines before the shuffle.
    common = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).join(hosts, "host").where("n > limit")
    salted = common.select("host", "h", "limit", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = cut(lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"]))
    often = met.groupBy("host", "h", "limit").agg(F.count_distinct("who").alias("docs"), F.count_distinct("copy").alias("texts")).where((F.col("docs") > F.col("limit")) & (F.col("texts") > min_docs))
    often = often.select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = met.join(often, ["host", "h", "salt"])
    lost = gone.groupBy("row").agg(F.sum("words").alias("lost_words"), F.collect_list("h").alias("removed"))
    judged = marked.drop("lines").join(lost, "row", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_words") <= depleted * F.col("n_words")))


def _host(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keep_good_documents(docs: DataFrame, **rules) -> DataFrame:
    """docs without rejected rows; template lines are gone from the texts that stay.

    docs has doc_id, source, text and n_chars; n_chars follows the text. Each
    row is judged by its own host and text, whatever other rows have its
    doc_id, or none. Other cases as in line_quality.
    """
    key = ["doc_id", "host", "copy"]
    verdicts = line_quality(docs, **rules).where("kept").groupBy(*key).agg(F.any_value("removed").alias("removed"))
    hashes = fresh(docs.columns, "removed")
    kept = verdicts.select(F.col("doc_id").alias("id_"), F.col("host").alias("host_"), F.col("copy").alias("copy_"), F.col("removed").alias(hashes))
    same = docs["doc_id"].cast("long").eqNullSafe(kept["id_"]) & (_host("source") == kept["host_"]) & (F.xxhash64("text") == kept["copy_"])
    joined = docs.join(kept, same)
    names = docs.columns

    def strip(batches):
        for batch in small(batches):
            out = []
            for text, removed in zip(texts(batch["text"]), batch[hashes].to_pylist(), strict=True):
                if removed and text:
                    gone = set(removed)
                    text = b"\n".join(x for x in text.split(b"\n") if line_hash(x) not in gone)
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()) if c == "text" else batch[c] for c in names], names=names)

    return joined.select(*names, hashes).mapInArrow(strip, docs.schema).withColumn("n_chars", F.length("text").cast("long"))


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d
), tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), often3 AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM often3) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(ls) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), line AS (
  SELECT doc_id, host, text, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         regexp_replace(array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' '), '[0-9]+', '0', 'g') AS norm
  FROM (SELECT doc_id, host, text, unnest(ls) AS line FROM w)
), host AS (
  SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host
), often AS (
  SELECT host, norm FROM line WHERE words > 0 GROUP BY host, norm
  HAVING count(DISTINCT doc_id) > greatest(10, (SELECT docs FROM host WHERE host.host = line.host) * 0.05) AND count(DISTINCT text) > 10
), lost AS (
  SELECT doc_id, sum(words)::BIGINT AS n FROM line JOIN often USING (host, norm) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS lost_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)
), g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND lost_words <= 0.5 * n_words AS kept FROM g
"""
