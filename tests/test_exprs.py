"""Hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from peakloom.functions import exprs as X
from peakloom.operators import joins as J
from peakloom.operators import windows as W


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_masses(spark):
    L = F.lit
    assert one(spark, X.ppm(L(500.005), L(500.0))) == pytest.approx(10.0)
    assert one(spark, X.ppm(L(500.0), L(500.005))) == pytest.approx(9.9999, abs=1e-6)
    assert one(spark, X.shifted_mz(L(500.0), L(2), 10.0)) == pytest.approx(499.99501007, abs=1e-6)
    assert one(spark, X.shifted_mz(L(500.0), L(2), -10.0)) == pytest.approx(500.00498993, abs=1e-6)
    assert one(spark, X.in_defect_range(L(1000.5), 0.1)) and not one(spark, X.in_defect_range(L(1000.9), 0.1))
    assert one(spark, X.mz_of_mass(X.neutral_mass(L(500.0), L(3)), L(3))) == pytest.approx(500.0)


def test_overlaps(spark):
    cases = [((10, 14), (12, 20)), ((10, 20), (12, 14)), ((12, 14), (10, 20))]
    second = [one(spark, X.overlap_of_second(*[F.lit(float(v)) for v in (*a, *b)])) for a, b in cases]
    first = [one(spark, X.overlap_of_first(*[F.lit(float(v)) for v in (*a, *b)])) for a, b in cases]
    assert second == pytest.approx([0.25, 1, 0.2]) and first == pytest.approx([0.5, 0.2, 1])
    assert one(spark, X.overlap_of_first(*[F.lit(v) for v in (0.0, 1.0, 2.0, 3.0)])) == 0


def test_strings(spark):
    L = F.lit
    assert [one(spark, X.is_decoy(L(s), "rev_")) for s in ("rev_P1", "P1rev_", "P1")] == [True, True, False]
    assert not one(spark, X.all_decoys(F.array(L("rev_P1"), L("P2")), "rev_")) and one(spark, X.all_decoys(F.array().cast("array<string>"), "rev_"))
    assert one(spark, X.missed_cleavages(L("PEKTRPKAR"))) == 2
    assert [one(spark, X.isotope_error_corrected(L(v))) for v in (1.01, 2.49, 2.51, 3.6)] == [-1, -2, -3, None]
    mods = one(spark, X.modifications(L("Oxidation(M);Phospho(S);")))
    assert [(m.name, m.site) for m in mods] == [("Oxidation", "M"), ("Phospho", "S")]
    assert one(spark, X.modification_text(X.modifications(L("Oxidation(M)")))) == "Oxidation(M)"
    assert one(spark, X.run_name(L("a.b.c"))) == "a" and one(spark, X.gene_name(L("x GN=TP53 PE=1"))) == "TP53"
    assert one(spark, X.modification_key(L(15.9949), L("M"))) == "[15.995(M)]"
    assert one(spark, X.safe_ln(L(0.0))) == -math.inf


def test_arrays(spark):
    big = F.array(*[F.lit(float(v)) for v in range(11)])
    assert one(spark, X.nth_largest(big, 1)) == 10 and one(spark, X.nth_largest(F.slice(big, 1, 10), 1)) == -1
    assert one(spark, X.complete_isotopes(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0)), 2)) and not one(spark, X.complete_isotopes(F.array(F.lit(1.0), F.lit(0.0)), 2))
    assert one(spark, X.weighted_score([1.0, 2.0], F.array(F.lit(3.0), F.lit(4.0)))) == 11


def test_ranks(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.8), (1, 0.7)], "f int, corr double")
    got = sorted((r["rank"], r.rank_score) for r in W.rank_share(df, ["f"], [F.desc("corr")]).collect())
    assert got == [(1, 0.25), (2, 0.5), (2, 0.5), (4, 1.0)]


@pytest.mark.parametrize(("rows", "fdr", "threshold", "kept"), [
    ("0.99T 0.98T 0.95T 0.90D 0.85T 0.80T 0.70D 0.60T", 0.2, 0.90, 3), ("0.99T 0.98T 0.95T 0.90D 0.85T 0.80T 0.70D 0.60T", 0.4, 0.70, 5), ("0.99T 0.50T 0.05D", 0.01, 0.0, 2),
])
def test_fdr(spark, rows, fdr, threshold, kept):
    df = spark.createDataFrame([(i, float(x[:-1]), x[-1] == "D") for i, x in enumerate(rows.split())], "k long, p double, decoy boolean")
    assert W.fdr_threshold(df, "p", "decoy", "k", fdr).first().threshold == threshold
    assert W.fdr_filter(df, "p", "decoy", "k", fdr).count() == kept


def test_fdr_is_the_plain_loop(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        rows = [(i, rng.randrange(60) / 60, rng.random() < 0.3) for i in range(80)]
        pos = neg = 0
        last, want = None, 0.0
        for k, p, d in sorted(rows, key=lambda r: (-r[1], r[0])):
            pos, neg = pos + (not d), neg + d
            if p < 0.1:
                break
            if last is not None and p < last and neg >= 0.25 * pos:
                want = p
                break
            last = p
        assert W.fdr_threshold(spark.createDataFrame(rows, "k long, p double, decoy boolean"), "p", "decoy", "k", 0.25).first().threshold == want


def test_lookups(spark):
    keys = spark.createDataFrame([(500.0,), (1000.0,), (1500.0,)], "key double")
    left = spark.createDataFrame([(700.0,), (1000.0,), (1600.0,)], "m double")
    assert sorted((r.m, r.key) for r in J.ceiling_lookup(left, keys, "m", "key", []).collect()) == [(700, 1000), (1000, 1000), (1600, 1500)]
    scans = spark.createDataFrame([("r", 1.0, 1), ("r", 2.0, 2), ("r", 3.0, 3)], "run string, rt double, scan int")
    want = spark.createDataFrame([("r", 0.5), ("r", 2.0), ("r", 2.5), ("r", 3.5)], "run string, t double")
    assert sorted((r.t, r.scan) for r in J.asof_join(want, scans, "t", "rt", ["scan"], ["run"], strict=True, clamp=True).collect()) == [(0.5, 1), (2.0, 1), (2.5, 2), (3.5, 3)]


def test_tight_first(spark):
    c = spark.createDataFrame([("c1", 10.0, 12.0), ("c2", 11.5, 13.0)], "c string, lo double, hi double")
    for rt, want in ((11.0, ["c1"]), (14.0, ["c1", "c2"])):
        m = c.where((F.lit(rt) >= F.col("lo") - 2) & (F.lit(rt) <= F.col("hi") + 2)).withColumn("k", F.lit(1))
        assert sorted(r.c for r in J.tight_first(m, ["k"], (F.lit(rt) > F.col("lo")) & (F.lit(rt) < F.col("hi"))).collect()) == want


def test_range_joins_are_brute_force(spark):
    import random

    rng = random.Random(5)
    points = [(i, rng.randrange(2), float(rng.randrange(100)) / 2) for i in range(60)]
    spans = [(i, rng.randrange(2), (a := float(rng.randrange(100)) / 2), a + rng.randrange(12)) for i in range(30)]
    p, s = spark.createDataFrame(points, "i long, g int, x double"), spark.createDataFrame(spans, "j long, g int, lo double, hi double")
    for width in (1.0, 5.0, 100.0):
        got = sorted((r.i, r.j) for r in J.range_join(p, s, "x", "lo", "hi", width, ["g"]).collect())
        assert got == sorted((i, j) for i, g, x in points for j, h, lo, hi in spans if g == h and lo <= x <= hi)
        t = s.select(F.col("j").alias("k"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "g")
        both = sorted((r.j, r.k) for r in J.overlap_join(s, t, "lo", "hi", "lo2", "hi2", width, ["g"]).collect())
        assert both == sorted((a[0], b[0]) for a in spans for b in spans if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    q = [(j, 400 * (1 + rng.random() * 1e-4)) for j in range(60)]
    a, b = spark.createDataFrame(q, "i long, x double"), spark.createDataFrame(q, "j long, y double")
    assert sorted((r.i, r.j) for r in J.ppm_join(a, b, "x", "y", 12.0).collect()) == sorted((i, j) for i, x in q for j, y in q if abs(x - y) * 1e6 / y <= 12.0)
