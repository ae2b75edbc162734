"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregation (minimum, combined before the shuffle) and an equi-join that Spark
may split where skewed; nothing gathers a node's neighbours. Each round is written to the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v") if not large else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # edges have u > v; the least of a node and its neighbours (large) or smaller neighbours (small)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = both.join(low, F.col("u") == F.col("_u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()


def components(edges: DataFrame) -> DataFrame:
    """u, v -> node, component (its least node). Nodes without an edge to another node have no row."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = _mark(now)
    while mark[0]:
        now = written(_stars(_stars(now, True), False))
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
