"""Operator 7, quality rules with adaptive thresholds.

Every document gets a handful of rates. Per language and source each rate is summed up in a
mergeable quantile sketch: counts in logarithmic bins of ratio GAMMA, so a sketch is a plain
count per bin, merging is adding, and any quantile is within 1 % of the exact one. Fences
(upper quartile plus REACH spreads, lower quartile minus the same) replace fixed cutoffs. A
group of fewer than LEAST rows takes its language's merged sketch, a small language the merged
sketch of everything. Documents outside a fence are rejected by a join with the fences.

Null text has no words and fails the base rule, as empty text does. Null language or source
counts as the empty string, one group with it. Very long texts are measured whole. Ties and repeated rows are counted each. Columns other than doc_id, text,
lang and source are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

#: Ratio of neighbouring bins.
GAMMA = 1.02
#: Fences stand this many spreads beyond the quartiles.
REACH = 4.0
#: Rows from which on a group has fences of its own.
LEAST = 100
#: Groups whose fences may be broadcast; parts of a group's rows beyond that.
SMALL, SALTS = 20_000, 64
#: The least spread of each rate, so that a group without variation doesn't reject small differences; second: whether low values are judged too.
RATES: dict[str, tuple[float, bool]] = {
    "symbols": (0.02, False),  # characters of #*$%&|<> a word
    "marks": (0.04, False),  # characters of !? a word
    "capitals": (0.03, False),  # A-Z among the word characters
    "length": (0.5, True),  # characters a word
    "dup_lines": (0.15, False),  # repeated lines a line
    "repeats": (0.12, False),  # words in repeated windows a word
}
SYMBOLS = "#*$%&|<>"
METRICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_capitals long"


def measure(text: str) -> tuple[int, ...]:
    """The counts of METRICS, without doc_id."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly space, TAB, LF, VT, FF, CR
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.encode().split():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            again = bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    again[j : j + 3] = again[i : i + 3] = b"\1\1\1"
            repeat = sum(again)
    capitals = sum(map(raw.count, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if not raw.islower() else 0
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, lines, text.count("!") + text.count("?"), capitals


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "") for t in batch.column(1).to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *cols], names=names)

    schema = METRICS.replace("doc_id long", "doc_id long, lang string, source string")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).mapInArrow(run, schema)


def rates() -> dict[str, Column]:
    a = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    return {"symbols": a("n_symbols", "n_words"), "marks": a("n_marks", "n_words"), "capitals": a("n_capitals", "word_chars"), "length": a("word_chars", "n_words"), "dup_lines": a("n_dup_lines", "n_lines"), "repeats": a("n_repeat_words", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rate, bin, n: one row a bin that has rows. Zero has a bin of its own. Base failures don't shape the fences."""
    exploded = measured.where(~base_failed()).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("x")) for k, v in rates().items()])).alias("r"))
    at = F.when(F.col("r.x") > 0, F.round(F.log("r.x") / math.log(GAMMA)).cast("int")).otherwise(F.lit(-100_000))
    return exploded.groupBy("lang", "source", F.col("r.rate").alias("rate"), at.alias("bin")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, rate, rows, q1, q3 of merged sketches."""
    merged = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "rate")
    up = merged.withColumn("up", F.sum("n").over(w.orderBy("bin"))).withColumn("rows", F.sum("n").over(w))
    value = F.when(F.col("bin") == -100_000, F.lit(0.0)).otherwise(F.exp(F.col("bin") * math.log(GAMMA)))
    q = lambda p: F.min(F.when(F.col("up") >= F.col("rows") * p, value))
    return up.groupBy(*by, "rate").agg(F.max("rows").alias("rows"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def fences(sketch: DataFrame, reach: float = REACH, least: int = LEAST) -> DataFrame:
    """lang, source, and per rate low_ and high_: of the group if it has enough rows, else of the language, else of all."""
    own = quartiles(sketch, "lang", "source")
    lang = quartiles(sketch, "lang").select("lang", "rate", F.col("rows").alias("l_rows"), F.col("q1").alias("l_q1"), F.col("q3").alias("l_q3"))
    every = quartiles(sketch).select("rate", F.col("q1").alias("a_q1"), F.col("q3").alias("a_q3"))
    picked = own.join(lang, ["lang", "rate"]).join(F.broadcast(every), "rate")  # a row a rate
    pick = lambda q: F.when(F.col("rows") >= least, F.col(q)).when(F.col("l_rows") >= least, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    spread = F.lit(0.0)
    for k, (s, _) in RATES.items():
        spread = F.when(F.col("rate") == k, F.lit(s)).otherwise(spread)
    picked = picked.select("lang", "source", "rate", pick("q1").alias("q1"), pick("q3").alias("q3"), spread.alias("s"))
    reached = reach * F.greatest(F.col("q3") - F.col("q1"), F.col("s"))
    of = lambda k, x: F.max(F.when(F.col("rate") == k, x))
    return picked.groupBy("lang", "source").agg(*[of(k, F.col("q3") + reached).alias(f"high_{k}") for k in RATES], *[of(k, F.col("q1") - reached).alias(f"low_{k}") for k, (_, low) in RATES.items() if low])


def judged(docs: DataFrame) -> DataFrame:
    """A row per document: the base counts, base_failed, kept, and `outside`, the rates beyond their fences."""
    measured = written(metrics(docs))  # narrow; read twice
    bounds = written(fences(sketches(measured)))  # a row a group
    if bounds.count() <= SMALL:
        joined = measured.join(F.broadcast(bounds), ["lang", "source"], "left")
    else:  # a group's rows go to SALTS tasks, its fences to each of them
        spread = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, ["lang", "source", "_salt"], "left")
    outside = F.array_compact(F.array(*[F.when((x > F.col(f"high_{k}")) | ((x < F.col(f"low_{k}")) if RATES[k][1] else F.lit(False)), F.lit(k)) for k, x in rates().items()]))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (F.size(outside) == 0)).alias("kept"), outside.alias("outside"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir, "doc_id", "text", "lang", "source")).drop("outside")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep; null and empty texts go, as they have too few words. Of rows that share a doc_id all stay if one is kept. Further columns pass through."""
    good = judged(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(good, F.col("doc_id") == F.col("_kept_id"), "left_semi")
