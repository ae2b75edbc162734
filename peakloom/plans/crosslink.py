"""Cross-linked peptide pairs from co-eluting clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from .extract import coelution

#: Masses of the linker's core and arm, of water and hydrogen.
CORE, ARM, H2O, H = 112.0995, 68.0, 18.0, 1.0


def mass_pairs(clusters: DataFrame, ppm: float, apex_delta: float, per_minute: float | None = None) -> DataFrame:
    """A and B apart by the core, or by core, water and arm, eluting together; per A, shift and charge the best B: that of the highest correlation, then of the least ppm.

    With per_minute the clusters' traces (rt, intensity) are correlated; without, all pairs correlate alike (0) and ppm decides.
    """
    a = clusters.select("run", F.col("cluster_id").alias("a"), F.col("mass").alias("a_mass"), F.col("apex_rt").alias("a_rt"), *_trace(per_minute, "a")).withColumn("shift", F.explode(F.array(F.lit(CORE), F.lit(CORE + H2O + ARM)))).withColumn("want", F.col("a_mass") + F.col("shift"))
    b = clusters.select("run", F.col("cluster_id").alias("b"), F.col("mass").alias("b_mass"), F.col("apex_rt").alias("b_rt"), F.col("charge").alias("b_charge"), *_trace(per_minute, "b"))
    m = J.ppm_join(a, b, "want", "b_mass", ppm, ["run"]).where(F.abs(F.col("a_rt") - F.col("b_rt")) <= apex_delta).withColumn("error", F.abs(F.col("want") - F.col("b_mass")) * 1e6 / F.col("b_mass"))
    m = m.withColumn("corr", F.lit(0.0) if per_minute is None else coelution("a_x", "a_y", "b_x", "b_y", F.lit(per_minute)))
    best = m.groupBy("run", "a", "shift", "b_charge").agg(F.min(F.struct((-F.col("corr")).alias("down"), "error", "b")).alias("m"), F.first("a_mass").alias("mass"), F.first("a_rt").alias("rt"))
    return best.select("run", "a", "shift", "b_charge", "mass", "rt", F.col("m.b").alias("b"), F.col("m.error").alias("ppm"), (-F.col("m.down")).alias("corr"))


def _trace(per_minute: float | None, side: str) -> list:
    return [] if per_minute is None else [F.col("rt").alias(f"{side}_x"), F.col("intensity").alias(f"{side}_y")]


def grouped_pairs(pairs: DataFrame, width: float) -> DataFrame:
    """Pairs whose masses lie close in one run, as one: centroids and greatest intensities. pairs: run, a_mass, b_mass, a_intensity, b_intensity."""
    from ..operators.windows import sessions

    g = sessions(pairs, ["run"], "a_mass", "b_mass", width, "group")
    return g.groupBy("run", "group").agg(F.avg("a_mass").alias("a_mass"), F.avg("b_mass").alias("b_mass"), F.max("a_intensity").alias("a_intensity"), F.max("b_intensity").alias("b_intensity"), F.count("*").alias("pairs"))


def pair_pairs(pairs: DataFrame, apex_delta: float) -> DataFrame:
    """Pairs of pairs that elute together, the lighter first."""
    p = pairs.select("run", F.col("a").alias("low"), F.col("mass").alias("low_mass"), F.col("rt").alias("low_rt")).distinct()
    q = p.select("run", F.col("low").alias("high"), F.col("low_mass").alias("high_mass"), F.col("low_rt").alias("high_rt"))
    return J.band_join(p, q, "low_rt", "high_rt", apex_delta, ["run"]).where("low_mass < high_mass or (low_mass = high_mass and low <= high)")


def intact(found: DataFrame, clusters: DataFrame, ppm: float, apex_delta: float) -> DataFrame:
    """Clusters whose mass is the sum of a pair of pairs and the core."""
    want = found.withColumn("want", F.col("low_mass") + F.col("high_mass") + CORE)
    c = clusters.select("run", F.col("cluster_id").alias("intact"), F.col("mass").alias("i_mass"), F.col("apex_rt").alias("i_rt"))
    m = J.ppm_join(want, c, "want", "i_mass", ppm, ["run"])
    return m.where((F.abs(F.col("i_rt") - F.col("low_rt")) <= apex_delta) & (F.abs(F.col("i_rt") - F.col("high_rt")) <= apex_delta))


def spectrum_pairs(groups: DataFrame, ppm: float, top: int = 50) -> DataFrame:
    """Within one spectrum, among its `top` groups: fragment groups apart by the core, and two such pairs that sum to the precursor's mass. groups: run, scan_num, mass, intensity, precursor_mass."""
    from ..operators.windows import top_k

    g = top_k(groups, ["run", "scan_num"], [F.desc("intensity"), F.asc("mass")], top)
    a = g.select("run", "scan_num", "precursor_mass", F.col("mass").alias("m"), (F.col("mass") + CORE).alias("want"))
    b = g.select("run", "scan_num", F.col("mass").alias("mate"))
    p = J.ppm_join(a, b, "want", "mate", ppm, ["run", "scan_num"])
    q = p.select("run", "scan_num", F.col("m").alias("m2")).distinct()
    rest = p.withColumn("other", F.col("precursor_mass") - F.col("m") - CORE)
    return J.ppm_join(rest, q, "other", "m2", ppm, ["run", "scan_num"]).where("m <= m2")


def maldi_pairs(peaks: DataFrame, tolerance: float = 0.7) -> DataFrame:
    """Pairs by mass within a spot."""
    a = peaks.select("spot", F.col("mz").alias("m"), (F.col("mz") + CORE).alias("want"))
    return J.band_join(a, peaks.select("spot", F.col("mz").alias("mate")), "want", "mate", tolerance, ["spot"])


def spot_runs(spots: DataFrame) -> DataFrame:
    """Runs of consecutive spots on a grid of rows A-H and columns 01-24."""
    from ..operators.windows import islands

    n = (F.ascii(F.substring("spot", 1, 1)) - 65) * 24 + F.substring("spot", 2, 2).cast("int")
    return islands(spots.withColumn("n", n), ["feature"], "n").groupBy("feature", "island").agg(F.min("n").alias("first"), F.count("*").alias("length"))
