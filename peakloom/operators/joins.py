"""Joins that Spark lacks, as equi-joins on bins with a residual predicate.

A plain range predicate plans as a nested loop. Binning gives Spark a hash key: the side with
intervals is repeated over the bins it meets, the other side has one bin, and the exact predicate
decides. Bins follow values, so a dense region is many keys, not one; Spark chooses broadcast or
shuffle by size and may split skewed bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ppm as ppm_of


def bin_of(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width))).cast("long")


def range_join(points: DataFrame, intervals: DataFrame, x: str, lo: str, hi: str, width: float, by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """points.x between intervals.lo and intervals.hi (both ends count). Column names must differ but for `by`."""
    by = by or []
    left = points.withColumn("_bin", bin_of(F.col(x), width))
    right = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_ibin", F.explode(F.sequence(bin_of(F.col(lo), width), bin_of(F.col(hi), width))))
    right = right.select(*[F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in right.columns])
    on = (F.col("_bin") == F.col("_ibin")) & F.col(x).between(F.col(lo), F.col(hi))
    for c in by:
        on &= F.col(c) == F.col(f"_by_{c}")
    return left.join(right, on, how).drop("_bin", "_ibin", *[f"_by_{c}" for c in by])


def band_join(left: DataFrame, right: DataFrame, x: str, y: str, tolerance: float, by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """abs(left.x - right.y) <= tolerance."""
    wide = right.withColumn("_lo", F.col(y) - tolerance).withColumn("_hi", F.col(y) + tolerance)
    return range_join(left, wide, x, "_lo", "_hi", max(2 * tolerance, 1e-9), by, how).drop("_lo", "_hi")


def ppm_join(left: DataFrame, right: DataFrame, x: str, y: str, tolerance: float, by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """ppm(left.x, right.y) <= tolerance; bins grow with the mass."""
    by = by or []
    step = math.log1p(2 * tolerance * 1e-6)
    at = lambda c: F.floor(F.ln(F.col(c)) / step).cast("long")
    a = left.withColumn("_bin", F.when(F.col(x) > 0, at(x)))
    b = right.where(F.col(y) > 0).withColumn("_ibin", F.explode(F.sequence(at(y) - 1, at(y) + 1)))
    b = b.select(*[F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in b.columns])
    on = (F.col("_bin") == F.col("_ibin")) & (ppm_of(x, y) <= tolerance)
    for c in by:
        on &= F.col(c) == F.col(f"_by_{c}")
    return a.join(b, on, how).drop("_bin", "_ibin", *[f"_by_{c}" for c in by])


def overlap_join(a: DataFrame, b: DataFrame, a_lo: str, a_hi: str, b_lo: str, b_hi: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of intervals that share a point. Both sides are repeated over bins; a pair counts in the first bin that both have."""
    by = by or []
    left = a.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(a_lo), width), bin_of(F.col(a_hi), width))))
    right = b.withColumn("_ibin", F.explode(F.sequence(bin_of(F.col(b_lo), width), bin_of(F.col(b_hi), width))))
    right = right.select(*[F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in right.columns])
    on = (F.col("_bin") == F.col("_ibin")) & (F.col(a_lo) <= F.col(b_hi)) & (F.col(b_lo) <= F.col(a_hi)) & (F.col("_bin") == bin_of(F.greatest(F.col(a_lo), F.col(b_lo)), width))
    for c in by:
        on &= F.col(c) == F.col(f"_by_{c}")
    return left.join(right, on).drop("_bin", "_ibin", *[f"_by_{c}" for c in by])


def asof_join(left: DataFrame, right: DataFrame, x: str, y: str, value: list[str], by: list[str], strict: bool = False, clamp: bool = False) -> DataFrame:
    """For each left row the right row of the same `by` with the greatest y <= x (< x if strict); with clamp the least y where there is none.

    One sort of both sides by key and time, no pairs. `by` keeps groups apart; a group is sorted by one task.
    """
    a = left.withColumn("_x", F.col(x)).withColumn("_side", F.lit(0 if strict else 1)).withColumn("_r", F.lit(None).cast(right.select(F.struct(F.col(y), *value).alias("s")).schema["s"].dataType))
    cols = [*left.columns, "_x", "_side", "_r"]
    b = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(y).alias("_x"), F.lit(1 if strict else 0).alias("_side"), F.struct(F.col(y), *value).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*by).orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = a.select(*cols).withColumn("_left", F.lit(True)).unionByName(b.withColumn("_left", F.lit(False)))
    got = F.last("_r", ignorenulls=True).over(w)
    if clamp:
        got = F.coalesce(got, F.first("_r", ignorenulls=True).over(everything))
    return both.withColumn("_got", got).where("_left").select(*left.columns, F.col(f"_got.{y}").alias(y), *[F.col(f"_got.{v}").alias(v) for v in value])


#: Rows of a table that a lookup sends to all tasks.
SMALL = 10_000


def ceiling_lookup(left: DataFrame, table: DataFrame, x: str, key: str, value: list[str], small: int = SMALL) -> DataFrame:
    """The table row of the least key >= x, else of the greatest key; null x finds nothing.

    A table of at most `small` rows is sent to all tasks as a sorted list of keys and searched there by halves, without a join; a larger
    one becomes ranges that are joined by bins of about ten keys.
    """
    rows = table.select(key, *value).limit(small + 1).count()
    if rows <= small:
        items = F.broadcast(table.agg(F.array_sort(F.collect_list(F.struct(key, *value))).alias("_items")))  # one row of `small` items
        found = left.crossJoin(items)
        place = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, rows).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(rows).alias("hi")), lambda s, _: _half(s, F.col("_items"), key, F.col(x)))
        hit = F.when(F.col(x).isNotNull(), F.try_element_at("_items", F.least(place["lo"], F.lit(rows - 1)) + 1)) if rows else F.lit(None)
        if not rows:
            return left.select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in (key, *value)])
        return found.withColumn("_hit", hit).select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in (key, *value)])
    ends = table.agg(F.min(key), F.max(key)).first()
    w = Window.partitionBy("_bin").orderBy(key)
    width = max((float(ends[1]) - float(ends[0])) / table.count() * 10, 1e-9)
    bins = table.withColumn("_bin", bin_of(F.col(key), width))
    firsts = bins.groupBy("_bin").agg(F.max(key).alias("_top"))  # a row a bin
    order = Window.orderBy("_bin")
    below = F.coalesce(F.lag(key).over(w), F.col("_before"))
    ranges = bins.join(firsts.select("_bin", F.lag("_top").over(order).alias("_before")), "_bin").select(key, *value, F.coalesce(below, F.lit(ends[0])).alias("_below"))
    clamped = left.withColumn("_x", F.greatest(F.least(F.col(x), F.lit(ends[1])), F.lit(ends[0])))
    hit = range_join(clamped, ranges, "_x", "_below", key, width, how="left")
    return hit.where((F.col("_x") > F.col("_below")) | (F.col(key) == F.col("_below")) | F.col(key).isNull()).drop("_x", "_below")


def _half(s: Column, items: Column, key: str, x: Column) -> Column:
    """One step of a search by halves for the number of keys below x."""
    middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    below = (s["lo"] < s["hi"]) & (F.try_element_at(items, middle + 1)[key] < x)
    return F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))


def in_blocks(left: DataFrame, right: DataFrame, pairs, small: int = SMALL) -> DataFrame:
    """All pairs of a stated set `right` and every row of `left` that `pairs(joined)` keeps: right goes to all tasks in blocks of about `small` rows, so no task holds more of it."""
    n = max(1, -(-right.count() // small))
    out = None
    for k in range(n):
        block = right if n == 1 else right.where(F.pmod(F.xxhash64(*right.columns), F.lit(n)) == k)
        part = pairs(left.crossJoin(F.broadcast(block)))
        out = part if out is None else out.unionByName(part)
    return out


def nearest_join(left: DataFrame, right: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """For each left row the nearest right value of its group; of two at one distance the lower."""
    low = asof_join(left, right.select(*by, F.col(y).alias("_low")), x, "_low", [], by)
    names = low.columns
    flipped = right.select(*by, (-F.col(y)).alias("_high"))
    both = asof_join(low.withColumn("_nx", -F.col(x)), flipped, "_nx", "_high", [], by).withColumn("_high", -F.col("_high"))
    pick = F.when(F.col("_high").isNull() | (F.col(x) - F.col("_low") <= F.col("_high") - F.col(x)), F.col("_low")).otherwise(F.col("_high"))
    return both.select(*[c for c in names if c != "_low"], pick.alias(y))


def tight_first(matches: DataFrame, key: list[str], tight: Column) -> DataFrame:
    """Of each key's matches only the tight ones, if it has any."""
    return matches.withColumn("_tight", tight).withColumn("_any", F.max(F.col("_tight").cast("int")).over(Window.partitionBy(*key))).where("_tight or _any = 0").drop("_tight", "_any")


def upsert_missing(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """target and the rows of source whose key it lacks."""
    return target.unionByName(source.join(target.select(*key).distinct(), key, "left_anti").select(*target.columns))


def union_first(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which a key's row comes from the first frame that has it."""
    whole = None
    for k, f in enumerate(frames):
        f = f.withColumn("_priority", F.lit(k))
        whole = f if whole is None else whole.unionByName(f)
    rest = [c for c in frames[0].columns if c not in key]
    return whole.groupBy(*key).agg(F.min(F.struct("_priority", *rest)).alias("_s")).select(*[F.col(c) if c in key else F.col(f"_s.{c}") for c in frames[0].columns])
