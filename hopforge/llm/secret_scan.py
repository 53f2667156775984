"""Secret scans: fixed patterns and a randomness test battery.

Everything here is a column expression; no row leaves the JVM. Three base
kinds are found by pattern. A fourth kind, ``random``, comes from a battery of
tests on long tokens. The token's encoding is inferred, and under it come
three p-values of randomness: chi-squared uniformity over the alphabet, runs
around its middle, and serial correlation. A fourth p-value is that of the
natural hypothesis: equal pairs of symbols as few as these, if symbols were
drawn with the frequencies of natural tokens of that encoding.

Two false-discovery controls over the whole input, both weighted by length
class, decide. The first takes the three tests' combined p-value and rejects
tokens that aren't random. The second takes the natural p-value and rejects
that hypothesis. What the second tells and the first leaves is reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.llm.support import cut, table, without

#: kind, pattern, group whose length counts, least length. Fixed values.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Candidate tokens of the battery.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order they are tried: name, pattern of the whole token, alphabet, sums of squared and of cubed
#: symbol frequencies in natural tokens (of prose's letters, or of numbers that people choose).
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS, 0.15, 0.03),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + LOWER[:6], 0.1, 0.012),
    ("uuid", "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", DIGITS + LOWER[:6], 0.1, 0.012),
    ("lower", "^[a-z]+$", LOWER, 0.0667, 0.0055),
    ("base32", "^(?:[A-Z2-7]+|[a-z2-7]+)$", LOWER + "234567", 0.0667, 0.0055),
    ("base36", "^(?:[A-Z0-9]+|[a-z0-9]+)$", LOWER + DIGITS, 0.0667, 0.0055),
    ("base64", "", UPPER + LOWER + DIGITS + "+/", 0.0667, 0.0055),
]
#: Lower ends of the length classes; p-value bins per factor of ten and their number.
CLASSES, PER_DECADE, BINS = (20, 24, 32, 48, 64), 20, 400

#: Coefficients of the fit of erfc, highest power first (Numerical Recipes, "erfcc"). Fixed values.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)

SPAN = "array<struct<at:int,upto:int,size:int,token:string>>"


def _spans(text: Column, pattern: str, group: int) -> Column:
    """All matches, leftmost first, as (start, end, length of the group, text) in code points."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("at"), end.alias("upto"), F.length(x["part"]).alias("size"), x["hit"].alias("token"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["hit"].isNull(), held["out"]).otherwise(F.concat(held["out"], F.array(span))).alias("out"))

    empty = F.array().cast(SPAN)
    walked = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda held: held["out"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _tail(z: Column) -> Column:
    """The upper tail of the normal law: half of erfc(z / sqrt 2), by Chebyshev fitting, right to 2e-7 of itself however far out."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(0.0)
    for c in ERFC:
        poly = poly * t + c
    half = t * F.exp(poly - x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _chi_tail(x: Column, k: Column) -> Column:
    """The upper tail of the chi-squared law with k - 1 degrees of freedom, k even: a finite series.

    Past 1400 it is below anything that is told apart here.
    """
    x = F.greatest(F.lit(0.0), F.least(F.lit(1400.0), x))
    root = F.sqrt(x)
    start = F.struct(root.alias("term"), F.lit(0.0).alias("sum"))
    # Terms x^(r - 1/2) / (1 * 3 * ... * (2r - 1)), r from 1 to (k - 2) / 2.
    step = lambda a, r: F.struct((a["term"] * x / (2 * r + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), ((k - 2) / 2).cast("int")), start, step, lambda a: a["sum"])
    return 2 * _tail(root) + 2 * F.exp(-x / 2) / math.sqrt(2 * math.pi) * series


def _gamma_below(x: Column, mean: Column, variance: Column) -> Column:
    """The lower tail of the gamma law of this mean and variance, by the cube-root transform."""
    ninth = variance / (9 * mean * mean)
    return _tail(-(F.pow(x / mean, F.lit(1 / 3)) - (1 - ninth)) / F.sqrt(ninth))


def _encoding(token: Column) -> Column:
    """Struct of the alphabet, its size, the natural frequencies' sums and the token in that alphabet's symbols."""
    chosen = None
    for name, whole, alphabet, s2, s3 in ENCODINGS:
        plain = F.translate(token, "-_", "+/") if name == "base64" else F.lower(F.replace(token, F.lit("-"), F.lit("")))
        found = F.struct(F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("k"), F.lit(s2).alias("s2"), F.lit(s3).alias("s3"), plain.alias("plain"))
        if chosen is None:
            chosen = F.when(token.rlike(whole), found)
        else:
            chosen = chosen.when(token.rlike(whole), found) if whole else chosen.otherwise(found)
    return chosen


def _statistics(e: Column) -> Column:
    """Struct of length, equal pairs of symbols, turns across the alphabet's middle, products of neighbours, and what the tests need of the encoding."""
    n, k = F.length(e["plain"]).cast("double"), e["k"]
    chars = F.split(e["plain"], "")
    pairs = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + (n - F.length(F.replace(e["plain"], c, F.lit("")))) * (n - F.length(F.replace(e["plain"], c, F.lit(""))) - 1) / 2)
    values = F.transform(chars, lambda c: F.instr(e["alphabet"], c) - 1)
    both = F.aggregate(
        values,
        F.struct(F.lit(None).cast("int").alias("prev"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("prod")),
        lambda a, v: F.struct(
            v.alias("prev"),
            (a["turns"] + F.when(a["prev"].isNotNull() & ((v >= k / 2) != (a["prev"] >= k / 2)), 1.0).otherwise(0.0)).alias("turns"),
            (a["prod"] + F.coalesce((v - (k - 1) / 2) * (a["prev"] - (k - 1) / 2), F.lit(0.0))).alias("prod"),
        ),
    )
    return F.struct(n.alias("n"), pairs.alias("pairs"), both["turns"].alias("turns"), both["prod"].alias("prod"), k.alias("k"), e["s2"].alias("s2"), e["s3"].alias("s3"))


def _p_values(x: Column) -> Column:
    """Struct of ``battery``, the three randomness tests' smallest p-value times three, and ``natural``."""
    n, k, s2, s3 = x["n"], x["k"], x["s2"], x["s3"]
    uniform = _chi_tail(k * (2 * x["pairs"] + n) / n - n, k)
    runs = 2 * _tail(F.greatest(F.lit(0.0), F.abs(x["turns"] - (n - 1) / 2) - 0.5) / F.sqrt((n - 1) / 4))
    serial = 2 * _tail(F.abs(x["prod"]) / ((k * k - 1) / 12 * F.sqrt(n - 1)))
    mean = n * (n - 1) / 2 * s2
    natural = _gamma_below(x["pairs"] + 0.5, mean, mean * (1 - s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2))
    least = F.lit(10.0 ** (-BINS / PER_DECADE))
    return F.struct(F.greatest(least, F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))).alias("battery"), F.greatest(least, F.least(F.lit(1.0), natural)).alias("natural"))


def _bin(p: Column) -> Column:
    """0 for a p-value of 1, larger bins for smaller ones."""
    return F.least(F.lit(BINS), F.floor(-F.log10(p) * PER_DECADE)).cast("int")


def _class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(n >= least, i).otherwise(out)
    return out


def discovery_bins(counts: list[tuple[int, int, int]], level: float) -> dict[int, int]:
    """The least bin of each length class whose hypothesis is rejected: the weighted step-up rule on binned p-values.

    counts: (class, bin, tokens). A token's weight doubles from one length
    class to the next longer one, as longer tokens tell more, and weights
    average one over all tokens. A bin counts with its largest p-value, so
    the control is on the safe side.
    """
    total = sum(n for _, _, n in counts)
    scale = sum(2.0**k * n for k, _, n in counts)
    limit = lambda k, found: 2.0**k * total / scale * level * found / total
    found, before = total, None
    while found and found != before:
        before = found
        found = sum(n for k, b, n in counts if 10 ** (-b / PER_DECADE) <= limit(k, before))
    out: dict[int, int] = {}
    for k, b, _ in counts:
        if found and 10 ** (-b / PER_DECADE) <= limit(k, found):
            out[k] = min(b, out.get(k, b))
    return out


def scan_secrets(docs: DataFrame, alpha: float = 0.001, level: float = 0.05, keep_text: bool = False) -> DataFrame:
    """Add ``found``, an array of (kind, start, end) in code points, end exclusive.

    The text itself is left out unless keep_text is set: the spans are held in
    the checkpoint folder until the whole input has been counted.

    docs has text (string); a null text is empty. Base kinds are leftmost and
    don't overlap within a kind; matches that fail a length are dropped after
    matching. Every run of 20 characters of TOKEN or more that no base span
    covers is tested. It is a ``random`` span if the false-discovery control
    at ``level`` rejects the natural hypothesis, and the control at ``alpha``
    doesn't reject randomness. Both look at all tokens of the input, and give
    longer tokens more weight. Short tokens of few symbols (digits, hex, lower
    case) hold too little to be told from natural ones and are mostly left.

    Spans are ordered by start, then by kind as listed. Repeated rows are
    scanned and counted each; all other columns stay, but a column named found
    is replaced. An empty table gives an empty table.
    """
    docs = without(docs, "found")
    carried = [c for c in docs.columns if keep_text or c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")
    long_enough = lambda least: lambda s: s["size"] >= least
    spans = [F.filter(_spans(text, pattern, group), long_enough(least)).alias(kind) for kind, pattern, group, least in BASE]
    first = docs.select(row, *spans, _spans(text, TOKEN, 0).alias("tokens"))

    def covered(s: Column) -> Column:
        out = F.lit(False)
        for kind, *_ in BASE:
            out = out | F.exists(kind, lambda b: (b["at"] <= s["at"]) & (s["upto"] <= b["upto"]))
        return out

    left = F.filter("tokens", lambda s: ~covered(s))
    span = lambda s, *more: F.struct(s["at"].alias("at"), s["upto"].alias("upto"), *more)
    tested = first.withColumn("tokens", F.transform(left, lambda s: span(s, _class(s["size"]).alias("class"), _encoding(s["token"]).alias("e"))))
    tested = tested.withColumn("tokens", F.transform("tokens", lambda s: span(s, s["class"].alias("class"), _statistics(s["e"]).alias("x"))))
    tested = tested.withColumn("tokens", F.transform("tokens", lambda s: span(s, s["class"].alias("class"), _p_values(s["x"]).alias("p"))))
    slim = lambda kind: F.transform(kind, lambda s: span(s)).alias(kind)
    binned = F.transform("tokens", lambda s: span(s, s["class"].alias("class"), _bin(s["p"]["battery"]).alias("battery"), _bin(s["p"]["natural"]).alias("natural")))
    held = cut(tested.select("row", *[slim(kind) for kind, *_ in BASE], binned.alias("tokens")))
    # At most one row a length class and pair of bins.
    counts = held.select(F.explode("tokens").alias("t")).groupBy("t.class", "t.battery", "t.natural").count().collect()
    not_random = discovery_bins([(c, b, n) for c, b, _, n in counts], alpha)
    unnatural = discovery_bins([(c, b, n) for c, _, b, n in counts], level)

    def rejected(s: Column, test: str, least: dict[int, int]) -> Column:
        out = F.lit(False)
        for i, b in least.items():
            out = out | ((s["class"] == i) & (s[test] >= b))
        return out

    def told(s: Column) -> Column:
        return rejected(s, "natural", unnatural) & ~rejected(s, "battery", not_random)

    def ranked(rank: int, kind: str):
        return lambda s: F.struct(s["at"].alias("at"), F.lit(rank).alias("rank"), s["upto"].alias("upto"), F.lit(kind).alias("kind"))

    kinds = [kind for kind, *_ in BASE]
    every = [F.transform(kind, ranked(i, kind)) for i, kind in enumerate(kinds)]
    every.append(F.transform(F.filter("tokens", told), ranked(len(kinds), "random")))
    sorted_ = F.array_sort(F.concat(*every))
    found = F.transform(sorted_, lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("start"), s["upto"].alias("end")))
    return held.select(*[F.col("row")[c].alias(c) for c in carried], found.alias("found"))


def op6_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs)
    base = F.filter("found", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))
