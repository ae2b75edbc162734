"""Signal extraction: scans to traces, isotope clusters, precursor-fragment edges and pseudo spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import at
from ..functions import exprs as X
from ..functions import signal as S
from ..operators import joins as J
from ..operators import windows as W
from .params import Parameters

TRACE = "run string, window_id string, island long, target_mz double, apex_rt double, apex_intensity double, start_rt double, end_rt double, n_points int, snr double, rt array<double>, intensity array<double>"


def trace(peaks: DataFrame, p: Parameters, ppm: float | None = None, parts: int = 32) -> DataFrame:
    """peaks: run, window_id, scan_num, rt, mz, intensity, background -> traces with an id.

    m/z is split at gaps that no trace can cross, so islands are traced independently and give the
    same traces as all at once. Islands are dealt to `parts` tasks a run and window, each of which also
    gets the whole scan axis, since scans without a peak count as misses.
    """
    ppm = ppm or p.ms1_ppm
    axis = peaks.groupBy("run", "window_id", "scan_num").agg(F.min("rt").alias("rt"), F.min("background").alias("background"))
    axis = axis.select(*[F.col(c).alias(c) for c in axis.columns], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))  # a row a scan and part
    split = W.ppm_islands(peaks.where((F.col("mz") >= p.min_mz) & (F.col("intensity") > F.col("background"))), ["run", "window_id"], "mz", ppm).withColumn("part", F.pmod(F.xxhash64("island"), F.lit(parts)).cast("int"))
    keys = ["target_mz", "apex_rt", "apex_intensity", "start_rt", "end_rt", "n_points", "snr", "rt", "intensity"]
    names = ["run", "window_id", "island", *keys]

    def some(pdf: pd.DataFrame, scans: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(scans):  # a part without islands
            return pd.DataFrame(columns=names)
        scans = scans.sort_values("scan_num")
        rts, backgrounds = scans["rt"].to_numpy(), scans["background"].to_numpy()
        place = np.searchsorted(scans["scan_num"].to_numpy(), pdf["scan_num"].to_numpy())
        mz, y, island = pdf["mz"].to_numpy(), pdf["intensity"].to_numpy(), pdf["island"].to_numpy()
        order = np.argsort(island, kind="stable")
        rows = []
        for own in np.split(order, np.nonzero(np.diff(island[order]))[0] + 1) if len(order) else []:
            for t in S.traced(place[own], mz[own], y[own], rts, backgrounds, ppm, p.missed_scans):
                if t["n_points"] >= p.min_points + 2 and t["snr"] >= p.min_snr:
                    rows.append((pdf["run"].iloc[0], pdf["window_id"].iloc[0], island[own[0]], *[t[k] for k in keys]))
        return pd.DataFrame(rows, columns=names)

    by = ["run", "window_id", "part"]
    traces = split.groupBy(*by).cogroup(axis.groupBy(*by)).applyInPandas(some, TRACE)
    return traces.withColumn("curve_id", F.xxhash64("run", "window_id", "target_mz", "apex_rt", "start_rt"))


def smooth(traces: DataFrame, per_minute: float, p: Parameters) -> DataFrame:
    """Traces cut into elution regions of their smoothed form; a row a region."""
    schema = "run string, window_id string, curve_id long, region int, target_mz double, apex_rt double, apex_intensity double, start_rt double, end_rt double, rt array<double>, intensity array<double>"

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                x, y = np.asarray(r.rt), np.asarray(r.intensity)
                n = int(max((x[-1] - x[0]) * per_minute, len(x)))
                sx, sy = S.bspline(x, y, n)
                scales = [2 * k + 5 for k in range(max(1, int(max(min(x[-1] - x[0], p.max_rt_range), 0.5) * per_minute / 10)))]
                for k, (a, _, b) in enumerate(S.regions(sx, sy, scales, p.symmetry)):
                    raw, mine = (x >= a) & (x <= b), (sx >= a) & (sx <= b)
                    if raw.sum() > 2 and mine.any():
                        top = int(np.argmax(np.where(mine, sy, -1)))
                        rows.append((r.run, r.window_id, r.curve_id, k, r.target_mz, float(sx[top]), float(sy[top]), float(a), float(b), sx[mine].tolist(), sy[mine].tolist()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return traces.select("run", "window_id", "curve_id", "target_mz", "rt", "intensity").mapInPandas(run, schema)


@F.pandas_udf(T.DoubleType())
def coelution(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, per_minute: pd.Series) -> pd.Series:
    return pd.Series([S.coelution(np.asarray(a), np.asarray(b), np.asarray(c), np.asarray(d), n) for a, b, c, d, n in zip(ax, ay, bx, by, per_minute)])


def clusters(curves: DataFrame, p: Parameters, per_minute: float) -> DataFrame:
    """Isotope clusters: for each curve as monoisotopic peak, charge and isotope number the best other curve by mass, co-elution and height; kept up to the first missing isotope."""
    own = curves.select("run", "window_id", F.col("curve_id").alias("id"), "region", "target_mz", "apex_rt", "apex_intensity", "start_rt", "end_rt", "rt", "intensity")
    low, high = p.charges
    charged = own.withColumn("charge", F.explode(F.sequence(F.lit(low), F.lit(high)))).where(X.precursor_gate(X.neutral_mass("target_mz", "charge"), *p.mass_range, p.defect_offset if p.defect_filter else None))
    want = charged.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(p.isotopes[1] - 1)))).withColumn("want", X.isotope_mz("target_mz", F.col("charge"), 0) + F.col("k") * X.PROTON / F.col("charge"))
    other = own.select("run", "window_id", *[F.col(c).alias(f"o_{c}") for c in ("id", "region", "target_mz", "apex_rt", "apex_intensity", "start_rt", "end_rt", "rt", "intensity")])
    tolerance = p.ms1_ppm * (1 + F.col("k") / 2)
    near = J.ppm_join(want, other, "want", "o_target_mz", p.ms1_ppm * (1 + p.isotopes[1] / 2), ["run", "window_id"]).where((X.ppm("want", "o_target_mz") <= tolerance) & (F.abs(F.col("apex_rt") - F.col("o_apex_rt")) <= p.apex_delta) & (X.overlap_of_second("start_rt", "end_rt", "o_start_rt", "o_end_rt") > 0.2))
    scored = near.withColumn("corr", coelution("rt", "intensity", "o_rt", "o_intensity", F.lit(per_minute))).where(F.col("corr") > p.iso_corr)
    ratio = F.col("o_apex_intensity") / F.col("apex_intensity")
    heavy = F.col("charge") * (F.col("target_mz") - X.PROTON) * 0.000594
    expected = F.pow(heavy, F.col("k")) / F.when(F.col("k") == 1, 1.0).when(F.col("k") == 2, 2.0).otherwise(6.0)
    fit = F.when(F.abs(ratio - expected) <= 0.396 * expected, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(ratio - expected)))
    scored = scored.withColumn("score", (tolerance - X.ppm("want", "o_target_mz")) / tolerance + F.col("corr") + fit)
    best = scored.groupBy("run", "window_id", "id", "region", "charge", "k").agg(F.max_by(F.struct(F.col("o_id").alias("curve"), F.col("o_target_mz").alias("mz"), F.col("o_apex_intensity").alias("height"), "corr", "score"), F.struct("score", -F.col("o_id"))).alias("b"), F.first("target_mz").alias("mono_mz"), F.first("apex_rt").alias("apex_rt"), F.first("apex_intensity").alias("apex_intensity"), F.first("start_rt").alias("start_rt"), F.first("end_rt").alias("end_rt"))
    whole = W.first_missing_prefix(best, ["run", "window_id", "id", "region", "charge"], "k")
    c = whole.groupBy("run", "window_id", "id", "region", "charge", "mono_mz", "apex_rt", "apex_intensity", "start_rt", "end_rt").agg(F.array_sort(F.collect_list(F.struct("k", "b"))).alias("iso"))
    return c.where(F.size("iso") + 1 >= p.isotopes[0]).select(
        "run", "window_id", F.xxhash64("run", "window_id", "id", "region", "charge").alias("cluster_id"), F.col("id").alias("curve_id"), "charge", X.neutral_mass("mono_mz", "charge").alias("mass"), "mono_mz", "apex_rt", "start_rt", "end_rt",
        F.concat(F.array("mono_mz"), F.transform("iso", lambda x: x["b"]["mz"])).alias("mz"), F.concat(F.array("apex_intensity"), F.transform("iso", lambda x: x["b"]["height"])).alias("height"), F.transform("iso", lambda x: x["b"]["curve"]).alias("isotope_curves"), F.transform("iso", lambda x: x["b"]["corr"]).alias("corrs"),
    )


def without_grouped(found: DataFrame) -> DataFrame:
    """Clusters whose monoisotopic curve is an isotope of another cluster of the same charge go; decided over all clusters at once."""
    taken = found.select("run", "window_id", F.explode("isotope_curves").alias("curve_id"), "charge").distinct()
    return found.join(taken, ["run", "window_id", "curve_id", "charge"], "left_anti")


def pairs(clusters_: DataFrame, fragments: DataFrame, windows: DataFrame, p: Parameters, per_minute: float) -> DataFrame:
    """Edges between precursor clusters and fragment curves of the isolation windows that hold them. clusters_ needs the traces of its curve (rt, intensity); fragments: run, window_id, curve_id, ...; windows: run, window_id, window_lo, window_hi."""
    w = F.broadcast(windows.select("run", F.col("window_id").alias("f_window"), "window_lo", "window_hi"))  # a few hundred windows a run
    top = at("mz", -1)
    c = clusters_.join(w, "run").where((top >= F.col("window_lo")) & (F.col("mono_mz") <= F.col("window_hi"))).drop("window_lo", "window_hi", "window_id").withColumnRenamed("f_window", "window_id")
    f = fragments.select("run", "window_id", F.col("curve_id").alias("fragment_id"), F.col("target_mz").alias("f_mz"), F.col("apex_rt").alias("f_apex"), F.col("apex_intensity").alias("f_intensity"), F.col("start_rt").alias("f_start"), F.col("end_rt").alias("f_end"), F.col("rt").alias("f_rt"), F.col("intensity").alias("f_y"))
    near = J.band_join(c, f, "apex_rt", "f_apex", p.apex_delta, ["run", "window_id"]).where((F.col("f_mz") <= F.col("mass")) & F.col("f_apex").between(F.col("start_rt"), F.col("end_rt")) & F.col("apex_rt").between(F.col("f_start"), F.col("f_end")))
    overlap = X.overlap_of_first("start_rt", "end_rt", "f_start", "f_end")
    e = near.withColumn("overlap", overlap).where(F.col("overlap") > p.overlap).withColumn("corr", coelution("rt", "intensity", "f_rt", "f_y", F.lit(per_minute))).where(F.col("corr") > p.corr)
    high = F.count_if(F.col("corr") > p.high_corr).over(Window.partitionBy("run", "window_id", "cluster_id"))
    return e.withColumn("_high", high).where(F.col("_high") >= p.high_corr_edges).select("run", "window_id", "cluster_id", "fragment_id", "charge", "mono_mz", "mass", "apex_rt", F.col("f_mz").alias("fragment_mz"), F.col("f_intensity").alias("intensity"), F.abs(F.col("apex_rt") - F.col("f_apex")).alias("apex_delta"), "overlap", "corr")


def enclosed_pairs(clusters_: DataFrame, points: DataFrame) -> DataFrame:
    """Every MS2 point within a cluster's time range is an edge whose correlation falls with its distance from the apex."""
    near = J.range_join(points, clusters_.select("run", "cluster_id", "apex_rt", "start_rt", "end_rt"), "rt", "start_rt", "end_rt", 1.0, ["run"])
    return near.withColumn("corr", 1 - F.abs(F.col("rt") - F.col("apex_rt")) / F.greatest(F.col("end_rt") - F.col("start_rt"), F.lit(1e-9)))


def filtered_edges(edges: DataFrame, p: Parameters) -> DataFrame:
    """Ranks of precursors per fragment and fragments per precursor, and the rule that keeps an edge."""
    a = W.rank_share(edges, ["run", "window_id", "fragment_id"], [F.desc("corr")], "ms1_rank", "ms1_rank_score")
    b = W.ranked(a.withColumn("_s", F.pow("corr", F.lit(2)) * X.safe_ln("intensity")), ["run", "window_id", "cluster_id"], [F.desc("_s")], "fragment_rank").drop("_s")
    return b.where((F.col("corr") >= p.corr) & (F.col("fragment_rank") <= p.fragment_rank) & (F.col("ms1_rank") <= p.precursor_rank) & (F.col("apex_delta") <= p.apex_delta))


def boosted(edges: DataFrame, p: Parameters) -> DataFrame:
    """Complementary fragments (their masses sum to the precursor's) take the better partner's correlation and intensity."""
    own = edges.withColumn("_want", F.col("mass") - F.col("fragment_mz") + 2 * X.PROTON)
    mate = edges.select("run", "window_id", "cluster_id", F.col("fragment_id").alias("_mate"), F.col("fragment_mz").alias("_mz"), F.col("corr").alias("_corr"), F.col("intensity").alias("_int"))
    found = J.ppm_join(own, mate, "_want", "_mz", p.ms2_ppm, ["run", "window_id", "cluster_id"]).groupBy("run", "window_id", "cluster_id", "fragment_id").agg(F.max(F.struct("_corr", "_int")).alias("_best"))
    joined = edges.join(found, ["run", "window_id", "cluster_id", "fragment_id"], "left")
    better = F.coalesce(F.col("_best._corr") > F.col("corr"), F.lit(False))
    return joined.withColumn("complementary", F.col("_best").isNotNull()).withColumn("intensity", F.when(better, F.greatest("intensity", "_best._int")).otherwise(F.col("intensity"))).withColumn("corr", F.when(better, F.col("_best._corr")).otherwise(F.col("corr"))).drop("_best")


def pseudo_spectra(edges: DataFrame, isotopes: DataFrame, p: Parameters, adjust: bool = True) -> DataFrame:
    """run, tier, spectrum_id, charge, precursor_mz, rt, peaks. Tier Q1 for three isotopes or more, else Q2; fewer than min_fragments peaks give none."""
    y = F.col("intensity") * F.pow("corr", F.lit(2)) if adjust else F.col("intensity")
    s = edges.groupBy("run", "window_id", "cluster_id", "charge", "mono_mz", "apex_rt").agg(F.array_sort(F.collect_list(F.struct(F.col("fragment_mz").alias("mz"), y.alias("intensity")))).alias("peaks")).where(F.size("peaks") > p.min_fragments)
    return s.join(isotopes.select("run", "cluster_id", F.size("mz").alias("_n")).distinct(), ["run", "cluster_id"]).select("run", F.when(F.col("_n") >= 3, "Q1").otherwise("Q2").alias("tier"), F.concat_ws(":", "window_id", "cluster_id").alias("spectrum_id"), "charge", F.col("mono_mz").alias("precursor_mz"), F.col("apex_rt").alias("rt"), "peaks")


def fitting_fragments(curves: DataFrame, p: Parameters) -> DataFrame:
    """Fragment curves whose fraction of mass fits at charge 1 or 2."""
    return curves.where(X.fragment_fits("target_mz", p.defect_offset))


def unfragmented_spectra(edges: DataFrame, ms2_clusters: DataFrame, windows: DataFrame, p: Parameters, adjust: bool = True) -> DataFrame:
    """Tier Q3: precursors that went through their isolation window unbroken, so they are clusters of MS2 scans. edges: as `pairs` makes them, cluster_id being an MS2 cluster; only clusters whose m/z lies in their own window count."""
    w = windows.select("run", "window_id", "window_lo", "window_hi")
    inside = ms2_clusters.join(w, ["run", "window_id"]).where(F.col("mono_mz").between(F.col("window_lo"), F.col("window_hi")))
    own = edges.join(inside.select("run", "window_id", "cluster_id").distinct(), ["run", "window_id", "cluster_id"], "left_semi")
    return pseudo_spectra(own, ms2_clusters, p, adjust).withColumn("tier", F.lit("Q3"))


def raw_spectra(points: DataFrame, clusters_: DataFrame, p: Parameters) -> DataFrame:
    """Spectra of raw intensities for viewers: all MS2 points at the scan nearest to a cluster's apex, unboosted. points: run, window_id, scan_num, rt, mz, intensity; clusters_: run, window_id, cluster_id, charge, mono_mz, apex_rt."""
    scans = points.select("run", "window_id", "scan_num", "rt").distinct()
    near = J.band_join(clusters_.select("run", "window_id", "cluster_id", "charge", "mono_mz", "apex_rt"), scans.withColumnRenamed("rt", "s_rt"), "apex_rt", "s_rt", p.apex_delta, ["run", "window_id"])
    best = near.groupBy("run", "window_id", "cluster_id", "charge", "mono_mz", "apex_rt").agg(F.min_by("scan_num", F.struct(F.abs(F.col("s_rt") - F.col("apex_rt")), "scan_num")).alias("scan_num"))
    s = best.join(points.select("run", "window_id", "scan_num", "mz", "intensity"), ["run", "window_id", "scan_num"]).groupBy("run", "window_id", "cluster_id", "charge", "mono_mz", "apex_rt").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    return s.where(F.size("peaks") > p.min_fragments).select("run", F.lit("raw").alias("tier"), F.concat_ws(":", "window_id", "cluster_id").alias("spectrum_id"), "charge", F.col("mono_mz").alias("precursor_mz"), F.col("apex_rt").alias("rt"), "peaks")


def mz_variance(points: DataFrame, by: list[str]) -> DataFrame:
    """Population variance of m/z within each trace."""
    return points.groupBy(*by).agg(F.var_pop("mz").alias("mz_variance"))


def last_window_only(clusters_: DataFrame, windows: DataFrame) -> DataFrame:
    """A cluster in the overlap of two windows belongs to the lower one."""
    upper = F.lead("window_hi").over(Window.partitionBy("run").orderBy(F.desc("window_lo")))
    w = windows.withColumn("_next", upper)
    return clusters_.join(F.broadcast(w), "run").where(F.col("mono_mz").between(F.col("window_lo"), F.col("window_hi")) & (F.col("_next").isNull() | (F.col("mono_mz") > F.col("_next"))))


def without_contaminants(curves: DataFrame, share: float = 0.9, width: float = 0.1) -> DataFrame:
    """Drops m/z bins whose curves cover more than this share of the run. Extents and covers are added up before the shuffle; a run or bin is nowhere gathered."""
    ends = curves.groupBy("run").agg(F.min("target_mz").alias("_least"), (F.max("end_rt") - F.min("start_rt")).alias("_span"))  # a row a run
    b = curves.join(ends, "run").withColumn("_bin", F.ceil((F.col("target_mz") - F.col("_least")) / width))
    full = b.groupBy("run", "_bin").agg(F.sum(F.col("end_rt") - F.col("start_rt")).alias("_cover"), F.max("_span").alias("_all")).where(F.col("_cover") > share * F.col("_all")).select("run", "_bin")
    return b.join(full, ["run", "_bin"], "left_anti").select(*curves.columns)
