"""Ranks, thresholds, sessions and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Ties share the first position."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def rank_share(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank", share: str = "rank_score") -> DataFrame:
    df = ranked(df, by, order, rank)
    return df.withColumn(share, F.col(rank) / F.count("*").over(Window.partitionBy(*by)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; `order` has to be total. Spark drops rows beyond k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def best(df: DataFrame, by: list[str], order: Column, keep: list[str]) -> DataFrame:
    """The row of the greatest `order` of each group, combined before the shuffle."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*keep), order).alias("_b")).select(*by, *[F.col(f"_b.{c}").alias(c) for c in keep])


def running_counts(df: DataFrame, score: str, decoy: str, tie: str, bins: int = 1000) -> DataFrame:
    """A row a distinct score (in 0..1): pos, neg, the targets and decoys down to the first of its rows (ties by `tie`), and previous, the score above.

    Rows of one score are added up before any order is made, so scores that pile up cost a row. Counts per score bin are summed over a
    table of at most `bins` + 1 rows; only the distinct scores of one bin meet in one task.
    """
    one = F.col(decoy).cast("long")
    scores = df.groupBy(score).agg(F.sum(1 - one).alias("_p"), F.sum(one).alias("_n"), F.min_by(one, tie).alias("_first")).withColumn("_b", F.floor(F.col(score) * bins).cast("int"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = scores.groupBy("_b").agg(F.sum("_p").alias("_bp"), F.sum("_n").alias("_bn"), F.min(score).alias("_least"))
    offsets = totals.select("_b", F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_n0"), F.lag("_least").over(Window.orderBy(F.desc("_b"))).alias("_last"))
    w = Window.partitionBy("_b").orderBy(F.desc(score))
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = scores.join(F.broadcast(offsets), "_b")  # a row a bin
    return out.select(score, (F.col("_p0") + before("_p") + 1 - F.col("_first")).alias("pos"), (F.col("_n0") + before("_n") + F.col("_first")).alias("neg"), F.coalesce(F.lag(score).over(w), F.col("_last")).alias("previous"))


def fdr_threshold(df: DataFrame, score: str, decoy: str, tie: str, fdr: float, floor: float | None = 0.1) -> DataFrame:
    """One row, threshold: the first score strictly below its predecessor at which decoys reach fdr times targets (no targets count as reached); 0 if none. With a floor, scores below it end the search."""
    rows = running_counts(df, score, decoy, tie)
    hit = (F.col(score) < F.col("previous")) & (F.col("neg") >= fdr * F.col("pos"))
    if floor is not None:
        hit &= F.col(score) >= floor
    return rows.agg(F.coalesce(F.max(F.when(hit, F.col(score))), F.lit(0.0)).alias("threshold"))


def fdr_filter(df: DataFrame, score: str, decoy: str, tie: str, fdr: float, floor: float | None = 0.1) -> DataFrame:
    """Targets at or above the threshold, with it."""
    return df.crossJoin(F.broadcast(fdr_threshold(df, score, decoy, tie, fdr, floor))).where((F.col(score) >= F.col("threshold")) & ~F.col(decoy))


def sessions(df: DataFrame, by: list[str], x: str, tie: str, gap: float, name: str = "session") -> DataFrame:
    """Numbers runs of rows whose neighbours are at most `gap` apart, from 0."""
    w = Window.partitionBy(*by).orderBy(x, tie)
    new = F.when(F.col(x) - F.lag(x).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands(df: DataFrame, by: list[str], n: str, name: str = "island") -> DataFrame:
    """Rows with consecutive integers get one number."""
    return df.withColumn(name, F.col(n) - F.dense_rank().over(Window.partitionBy(*by).orderBy(n)))


def ppm_islands(df: DataFrame, by: list[str], mz: str, tolerance: float, name: str = "island") -> DataFrame:
    """Splits each group at gaps in m/z that no trace of this tolerance can cross."""
    w = Window.partitionBy(*by).orderBy(mz)
    new = F.when((F.col(mz) - F.lag(mz).over(w)) * 1e6 / F.col(mz) > tolerance, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def first_missing_prefix(df: DataFrame, by: list[str], k: str) -> DataFrame:
    """Rows of each group up to the first missing k (k from 1)."""
    w = Window.partitionBy(*by).orderBy(k)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col(k) == F.col("_r")).drop("_r")


def dense_index(df: DataFrame, by: list[str], order: list[Column], name: str = "index") -> DataFrame:
    """Numbers from 1 within each group along a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
