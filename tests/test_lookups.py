import pytest
from pyspark.sql import functions as F

from peakloom.operators import lookups as L


def test_modifications(spark):
    t = L.modification_table(spark, [("Own", "M", 16.2)])
    f = spark.createDataFrame([(1, "M", 15.99), (2, "M", 40.0), (3, "K", 15.99)], "k int, site string, massdiff double")
    assert {r.k: r.modification for r in L.nearest_modification(f, t).collect()} == {1: "Oxidation", 2: None, 3: None}
    assert L.enzyme_table(spark).count() == len(L.ENZYMES)


def test_scans(spark):
    s = spark.createDataFrame([("r", 1, 1), ("r", 2, 2), ("r", 3, 2), ("r", 4, 1), ("r", 5, 2)], "run string, scan_num long, ms_level int")
    assert [r.parent_scan for r in L.parent_scan(s).orderBy("scan_num").collect()] == [None, 1, 1, 1, 4]
    p = spark.createDataFrame([("r", 1, 500.0, 5.0, 1.0), ("r", 1, 500.004, 9.0, 1.0), ("r", 1, 501.0, 99.0, 1.0)], "run string, scan_num long, mz double, intensity double, rt double")
    t = spark.createDataFrame([("r", 1, 500.001)], "run string, scan_num long, target_mz double")
    assert L.highest_peak(t, p, 10.0).first().peak_mz == 500.004
    boxes = spark.createDataFrame([(500.0, 0.5, 1.5), (500.001, 0.0, 2.0)], "i_mz double, i_start double, i_end double")
    assert L.inclusion_hits(p, boxes, 20.0).count() == 2


def test_sequences(spark):
    fasta = spark.createDataFrame([("sp|P1|A", "MPEPTIDEK"), ("P2", "KK")], "acc string, sequence string")
    ids = spark.createDataFrame([("P2",), ("P1",), ("P9",)], "id string")
    assert {r.id: r.sequence for r in L.sequences_of(ids, fasta).collect()} == {"P2": "KK", "P1": "MPEPTIDEK", "P9": None}
    c = spark.createDataFrame([("MPEPK", "PEP"), ("MPEPK", "MPEPK"), ("AAA", "K")], "protein string, peptide string")
    assert [(r.before, r.after) for r in L.residue_context(c).collect()] == [("M", "K"), ("-", "-"), (None, None)]


def test_arrays_and_sums(spark):
    pts = F.array(*[F.struct(F.lit(m).alias("mz"), F.lit(i).alias("intensity")) for m, i in ((1.0, 5.0), (2.0, 9.0), (3.0, 7.0))])
    assert [p.mz for p in spark.range(1).select(L.top_peaks(pts, 2).alias("p")).first().p] == [2.0, 3.0]
    b = spark.createDataFrame([("a", float(v)) for v in range(20)], "k string, y double")
    assert L.baseline(b, ["k"], "y").first().baseline == 0.5
    e = spark.createDataFrame([("r", 1, 0.7), ("r", 1, 0.5), ("r", 2, 0.1)], "run string, fragment_id long, corr double")
    assert {r.fragment_id: r.conflict for r in L.conflict(e).collect()} == {1: 0.7, 2: 0.0}
    f = spark.createDataFrame([("p", "b1", 10.0, 0.5), ("p", "b1", 8.0, 0.9)], "pep_key string, frag_key string, intensity double, corr double")
    assert L.without_duplicates(f, ["pep_key", "frag_key"]).first().intensity == 8.0
    xy = spark.createDataFrame([("g", 1.0, 10.0), ("g", 2.0, 100.0), ("g", 3.0, 1000.0)], "k string, x double, y double")
    assert L.spearman(xy, ["k"], "x", "y").first().spearman == pytest.approx(1)
    s = spark.createDataFrame([("k", 100.02, 3.0), ("k", 200.05, 4.0)], "key string, mz double, intensity double")
    assert L.spectrum_dot(s, s).first().dot == pytest.approx(1)
    psms = spark.createDataFrame([(1, 500.0, 10.0, 2), (2, 500.0, 30.0, 2)], "k int, mz double, rt double, charge int")
    targets = spark.createDataFrame([(7, 500.001, 10.5, 2)], "target_id int, mz double, rt double, charge int")
    assert [r.k for r in L.close_psms(psms, targets, 10.0, 1.0).collect()] == [1]
