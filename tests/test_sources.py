"""Readers and writers on small files, and the pipelines on synthetic scans."""

import base64
import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from peakloom.operators.containment import contained
from peakloom.plans import crosslink, extract, identify, quant, rescore
from peakloom.plans.params import Parameters
from peakloom.sources import identifications as I
from peakloom.sources import sinks as K
from peakloom.sources import spectra as R

PAIRS = [(100.5, 10.0), (200.25, 0.0), (300.125, 30.0)]


def big(pairs, packed=False):
    raw = b"".join(struct.pack(">ff", m, i) for m, i in pairs)
    return base64.b64encode(zlib.compress(raw) if packed else raw).decode()


def put(path, text):
    path.write_text(text)
    return str(path)


def test_mzxml(spark, tmp_path):
    scan = lambda n, level, rt, more, packed: f'<scan num="{n}" msLevel="{level}" retentionTime="PT{rt}S" centroided="1" peaksCount="3">{more}<peaks precision="32" compressionType="{"zlib" if packed else "none"}">{big(PAIRS, packed)}</peaks></scan>'
    text = "<mzXML><msRun>" + scan(1, 1, 60, "", False) + scan(2, 2, 61.2, '<precursorMz precursorCharge="2">412.5</precursorMz>', True) + scan(3, 2, 62, '<precursorMz windowWideness="20">500</precursorMz>', False) + "</msRun></mzXML>"
    rows = R.read_spectra(spark, put(tmp_path / "a.mzXML", text)).orderBy("scan_num").collect()
    assert [r.ms_level for r in rows] == [1, 2, 2] and rows[0].rt == 1.0 and rows[0].mz == [100.5, 300.125] and rows[1].intensity == [10.0, 30.0]
    assert (rows[1].window_lo, rows[1].window_hi) == pytest.approx((407.3, 433.3)) and (rows[2].window_lo, rows[2].window_hi) == (490, 510) and rows[1].precursor_charge == 2
    df = R.read_mzxml(spark, str(tmp_path / "a.mzXML"))
    assert R.select_scans(df, (2,), start=1.03).count() == 1 and R.isolation_windows(df).count() == 2 and R.peaks(df).count() == 6


def xml_scan(n, level, more="", kind="Full", inside=""):
    return f'<scan num="{n}"\n msLevel="{level}" scanType="{kind}" retentionTime="PT{n}S" lowMz="400" highMz="420"><scanOrigin parentFileID="x" num="{n}"/>{more}<peaks precision="32">{big(PAIRS)}</peaks>{inside}</scan>'


def test_nested_mzxml(spark, tmp_path):
    """Children of a scan are scans of their own, and don't lend it their peaks or precursor."""
    child = xml_scan(2, 2, '<precursorMz windowWideness="10">410</precursorMz>') + xml_scan(3, 2, '<precursorMz windowWideness="10">430</precursorMz>')
    text = f"<mzXML><msRun>{xml_scan(1, 1, inside=child)}{xml_scan(4, 1, kind='calibration')}</msRun></mzXML>"
    rows = R.read_mzxml(spark, put(tmp_path / "n.mzXML", text)).orderBy("scan_num").collect()
    assert [(r.scan_num, r.ms_level, r.precursor_mz, r.window_lo) for r in rows] == [(1, 1, None, None), (2, 2, 410.0, 405.0), (3, 2, 430.0, 425.0), (4, -1, None, None)]
    assert all(r.mz == [100.5, 300.125] for r in rows)


def test_window_rules_of_acquisitions(spark, tmp_path):
    two = '<precursorMz windowWideness="4">410</precursorMz><precursorMz windowWideness="4">450</precursorMz>'
    path = put(tmp_path / "m.mzXML", "<msRun>" + xml_scan(1, 1, kind="SIM") + xml_scan(2, 2, two) + xml_scan(3, 2, '<precursorMz>700</precursorMz>') + "</msRun>")
    windows = spark.createDataFrame([(390.0, 425.0), (400.0, 500.0), (405.0, 410.0)], "window_lo double, window_hi double")
    got = lambda kind: sorted((r.scan_num, r.window_lo, r.window_hi) for r in R.read_mzxml(spark, path, acquisition=kind, windows=windows).collect() if r.window_lo is not None)
    assert got("msx") == [(2, 408.0, 412.0), (2, 448.0, 452.0)]
    assert got("mse") == [(2, 0.0, 10_000.0), (3, 0.0, 10_000.0)]
    assert got("variable") == [(2, 390.0, 425.0)]  # nothing holds 700
    assert got("sim") == [(1, 390.0, 425.0), (1, 400.0, 500.0)]
    assert got("fixed")[-1] == (3, pytest.approx(694.8), pytest.approx(720.8))


def test_mzml(spark, tmp_path):
    cv = lambda a, v="", u="": f'<cvParam accession="{a}" value="{v}" unitName="{u}"/>'
    arr = lambda a, xs: f'<binaryDataArray>{cv(a)}{cv("MS:1000523")}{cv("MS:1000574")}<binary>{base64.b64encode(zlib.compress(struct.pack(f"<{len(xs)}d", *xs))).decode()}</binary></binaryDataArray>'
    text = f'<mzML><run><spectrumList><spectrum index="0" id="controller scan=7">{cv("MS:1000511", 2)}{cv("MS:1000127")}<scanList><scan>{cv("MS:1000016", 90, "second")}</scan></scanList><precursorList><precursor><isolationWindow>{cv("MS:1000828", 10)}{cv("MS:1000829", 15)}</isolationWindow><selectedIonList><selectedIon>{cv("MS:1000744", 450.5)}{cv("MS:1000041", 3)}</selectedIon></selectedIonList></precursor></precursorList><binaryDataArrayList>{arr("MS:1000514", [1.5, 2.5])}{arr("MS:1000515", [0.0, 4.0])}</binaryDataArrayList></spectrum></spectrumList></run></mzML>'
    r = R.read_spectra(spark, put(tmp_path / "a.mzML", text)).first()
    assert (r.scan_num, r.ms_level, r.rt, r.precursor_mz, r.precursor_charge, r.window_lo, r.window_hi) == (7, 2, 1.5, 450.5, 3, 440.5, 465.5) and r.mz == [1.5, 2.5] and r.intensity == [0.0, 4.0] and r.centroided


def test_mgf_and_lists(spark, tmp_path):
    put(tmp_path / "s.mgf", "BEGIN IONS\nPEPMASS=500.5 100\nCHARGE=2+\nRTINSECONDS=120\nTITLE=s.5.5.2\n100.5 1\n200.5\t2\nEND IONS\nBEGIN IONS\nPEPMASS=300\n50 1\nEND IONS\n")
    put(tmp_path / "s.pkl", "300.5,20,x\n100.5,10,x\n")
    rows = sorted(R.read_mgf(spark, str(tmp_path / "s.mgf")).collect(), key=lambda r: -r.ms_level)
    assert (rows[0].ms_level, rows[0].scan_num, rows[0].rt, rows[0].mz) == (2, 5, 2.0, [100.5, 200.5]) and rows[1].ms_level == 1
    assert R.read_pkl(spark, str(tmp_path / "s.pkl")).first().mz == [100.5, 300.5]
    assert R.read_maldi(spark, str(tmp_path), 2.0).select("run", "rt").distinct().count() == 2
    with pytest.raises(ValueError):
        R.read_spectra(spark, "x.raw")


def test_search_results(spark, tmp_path):
    pep = '<msms_pipeline_analysis><spectrum_query spectrum="run1.10.10.2" start_scan="10" precursor_neutral_mass="1001.0" assumed_charge="2" retention_time_sec="60"><search_result><search_hit hit_rank="1" peptide="PEPTIDEK" protein="P1" calc_neutral_pep_mass="1000.0" massdiff="1.0"><alternative_protein protein="P2"/><modification_info modified_peptide="PEPT[181]IDEK"><mod_aminoacid_mass position="4" mass="181.01"/></modification_info><search_score name="expect" value="0.01"/><analysis_result analysis="peptideprophet"><peptideprophet_result probability="0.8"/></analysis_result><analysis_result analysis="interprophet"><interprophet_result probability="0.9"/></analysis_result></search_hit></search_result></spectrum_query></msms_pipeline_analysis>'
    r = I.read_pepxml(spark, put(tmp_path / "a.pepXML", pep)).first()
    assert (r.run, r.scan_num, r.mod_sequence, r.probability, r.parent_proteins, r.rt) == ("run1", 10, "PEPT[181]IDEK", 0.9, ["P1", "P2"], 1.0) and r.observed_mass == pytest.approx(999.99665) and r.mods[0].position == 4
    prot = '<protein_summary><protein_group group_number="3" probability="1.0"><protein protein_name="P1" probability="0.99"><indistinguishable_protein protein_name="P9"/><peptide peptide_sequence="PEPTIDEK" charge="2" initial_probability="0.9" weight="1.0" group_weight="1.0" is_nondegenerate_evidence="Y"/></protein><protein protein_name="rev_P2" probability="0.1"/></protein_group></protein_summary>'
    rows = I.read_protxml(spark, put(tmp_path / "a.protXML", prot)).orderBy("acc").collect()
    assert [(r.acc, r.protein_group) for r in rows] == [("P1", "3_a"), ("rev_P2", "3_b")] and rows[0].indistinguishable == ["P1", "P9"] and rows[0].nondegenerate
    assert I.read_protxml(spark, str(tmp_path / "a.protXML"), 0.5).count() == 1
    fasta = put(tmp_path / "a.fasta", ">P1 first GN=A\nMPEP\nTIDEK*\n>rev_P2 second\nKKK\n")
    got = {r.acc: (r.description, r.sequence) for r in I.read_fasta(spark, fasta).collect()}
    assert got == {"P1": ("first GN=A", "MPEPTIDEK"), "rev_P2": ("second", "KKK")} and I.read_fasta(spark, fasta, "rev_").count() == 1


def test_libraries_and_parameters(spark, tmp_path):
    tsv = "ModifiedSequence\tStrippedSequence\tPrecursorCharge\tPrecursorMz\tiRT\tFragmentType\tFragmentNumber\tFragmentCharge\tFragmentMz\tRelativeFragmentIntensity\nAK\tAK\t2\t100\t5\tb\t1\t1\t72\t10\nCK\tCK\t2\t110\t6\tb\t1\t1\t80\t10\nAK\tAK\t2\t100\t5\ty\t1\t1\t147\t90\n"
    lib = {r.mod_sequence: len(r.fragments) for r in I.read_library_tsv(spark, put(tmp_path / "l.tsv", tsv)).collect()}
    assert lib == {"AK": 2, "CK": 1}
    sptxt = "Name: PEPK/2\nPrecursorMZ: 300.5\n100.5\t20\tb1\n200.5\t30\ty2\n\nName: AAK/3\nPrecursorMZ: 200\n90\t1\ty1\n"
    assert sorted((r.mod_sequence, r.charge, len(r.fragments)) for r in I.read_sptxt(spark, put(tmp_path / "l.sptxt", sptxt)).collect()) == [("AAK", 3, 1), ("PEPK", 2, 2)]
    cv = lambda a, v: f'<cvParam accession="{a}" name="" value="{v}"/>'
    traml = f'<TraML><CompoundList><Peptide id="p1" sequence="PEPK">{cv("MS:1000041", 2)}<RetentionTimeList><RetentionTime>{cv("MS:1000896", 12.5)}</RetentionTime></RetentionTimeList></Peptide></CompoundList><TransitionList><Transition id="t1" peptideRef="p1"><Precursor>{cv("MS:1000827", 300.5)}</Precursor><Product>{cv("MS:1000827", 147.1)}{cv("MS:1000041", 1)}</Product>{cv("MS:1001226", 100)}</Transition></TransitionList></TraML>'
    r = I.read_traml(spark, put(tmp_path / "l.TraML", traml)).first()
    assert (r.sequence, r.charge, r.rt, r.precursor_mz, r.fragments[0].mz) == ("PEPK", 2, 12.5, 300.5, 147.1)
    p = I.parse_parameters("# x\nThread = 6\npara.MS1PPM=30.5\nFlag = true\nName=abc # y\n==window setting begin\n400 425\n==window setting end\n")
    assert p == {"Thread": 6, "SE.MS1PPM": 30.5, "Flag": True, "Name": "abc", "window setting": [["400", "425"]]}
    assert I.find_spectra(["a/x.mzXML", "a/x_Q1.mzxml".lower(), "y.mzML", "z.txt"]) == ["a/x.mzXML", "y.mzML"]


def synthetic(spark):
    """One peptide's isotopes in MS1 and a dozen co-eluting fragments."""
    rng = random.Random(2)
    shape = lambda t: math.exp(-((t - 5) ** 2) / 0.08)
    rows = []
    for s in range(100):
        t = 3 + s * 0.04
        for k, h in enumerate((1000.0, 700.0, 300.0)):
            rows.append(("r", "ms1", s, t, 600.3 + k * 1.00727 / 2, h * shape(t) + 0.5, 0.1))
        for f in range(12):
            rows.append(("r", "w1", s, t, 250.0 + 50.5 * f, (100 + 10 * f) * shape(t) + 0.5, 0.1))
        rows.append(("r", "w1", s, t, 999.9, rng.uniform(1, 5), 0.1))
    return spark.createDataFrame(rows, "run string, window_id string, scan_num long, rt double, mz double, intensity double, background double")


def test_extraction(spark, tmp_path):
    p = Parameters()
    traces = extract.trace(synthetic(spark), p).cache()
    assert {r.window_id: r["count"] for r in traces.groupBy("window_id").count().collect()}["ms1"] == 3
    curves = extract.smooth(traces, 25.0, p).cache()
    ms1 = curves.where("window_id = 'ms1'")
    found = extract.without_grouped(extract.clusters(ms1, p, 25.0)).where("charge = 2").cache()
    c = found.orderBy(F.desc(F.size("mz"))).first()
    assert c.mass == pytest.approx(2 * (600.3 - 1.00727), abs=1e-3) and len(c.mz) == 3 and c.apex_rt == pytest.approx(5, abs=0.1)
    shapes = ms1.select("run", "curve_id", F.col("rt").alias("rt"), "intensity")
    windows = spark.createDataFrame([("r", "w1", 590.0, 615.0)], "run string, window_id string, window_lo double, window_hi double")
    edges = extract.pairs(found.join(shapes, ["run", "curve_id"]), curves.where("window_id = 'w1'"), windows, p, 25.0)
    kept = extract.filtered_edges(extract.boosted(edges, p), p).cache()
    best = kept.where(F.col("cluster_id") == c.cluster_id)
    assert best.select("fragment_id").distinct().count() == 12 and best.agg(F.min("corr")).first()[0] > 0.9
    spectra = extract.pseudo_spectra(kept, found, p)
    bridge = K.write_mgf(spectra, str(tmp_path / "mgf"))
    assert bridge.count() == spectra.count() and "BEGIN IONS" in open(next((tmp_path / "mgf" / "tier=Q1").glob("*.txt"))).read()
    assert extract.without_contaminants(traces, 0.5).count() < traces.count()


def test_windows_and_containment(spark):
    w = spark.createDataFrame([("r", 400.0, 425.0), ("r", 424.0, 450.0)], "run string, window_lo double, window_hi double")
    c = spark.createDataFrame([("r", 424.5), ("r", 430.0)], "run string, mono_mz double")
    got = sorted((r.mono_mz, r.window_lo) for r in extract.last_window_only(c, w).collect())
    assert got == [(424.5, 400.0), (430.0, 424.0)]
    s = spark.createDataFrame([("A", "MPEPTIDEK"), ("B", None), ("C", "KKK")], "acc string, text string")
    q = spark.createDataFrame([("p", "PEP"), ("k", "K"), ("n", None), ("p2", "PEP")], "pid string, pat string")
    assert sorted(tuple(r) for r in contained(s, q).collect()) == [("A", "k"), ("A", "p"), ("A", "p2"), ("C", "k")]
    assert sorted(tuple(r) for r in contained(s, q, small=2).collect()) == [("A", "k"), ("A", "p"), ("A", "p2"), ("C", "k")]


def test_identification_and_quant(spark):
    psms = spark.createDataFrame([("r", f"s{i}", "AK", "AK", 2, 0.5 + i / 10, 500.0 + i, 1.0 * i, ["P1"] if i < 3 else ["rev_P1"]) for i in range(4)], "run string, spectrum string, sequence string, mod_sequence string, charge int, probability double, observed_mass double, rt double, parent_proteins array<string>")
    r = identify.peptide_ions(psms, "rev_").first()
    assert (r.psms, r.probability, r.mass_at_best, r.decoy, r.parent_proteins) == (4, 0.8, 503.0, False, ["P1", "rev_P1"]) and r.rt_sd == pytest.approx(math.sqrt(1.25))
    f = spark.createDataFrame([(f"r{k}", "p", g, 300.0, v, 0.9) for k in range(4) for g, v in (("b1", 100.0), ("y1", 50.0)) if g == "b1" or k < 2], "run string, pep_key string, frag_key string, mz double, intensity double, corr double")
    assert {x.frag_key for x in quant.fragment_scores(f, 4, 0.5).collect()} == {"b1"}
    lib = {x.frag_key: x.intensity for x in rescore.library(f, 4, 0.4, 6).collect()}
    assert lib["b1"] == 1.0 and lib["y1"] == pytest.approx(math.sqrt(0.5))
    heads = spark.createDataFrame([("rev_P1", ["rev_P1", "P2"]), ("P3", ["P3"])], "acc string, indistinguishable array<string>")
    assert sorted(x.acc for x in identify.fixed_heads(heads, "rev_").collect()) == ["P2", "P3"]


def test_mapping_keeps_distinct_predictions(spark):
    ions = spark.createDataFrame([(r, "k1", 2, 500.0, rt) for r, rt in (("a", 12.0), ("b", 12.0), ("c", 12.2))] + [("z", "k2", 2, 1.0, 1.0)], "run string, pep_key string, charge int, mass_at_best double, rt double")
    curve = spark.createDataFrame([("a", "z", 60, 12.0, 0.1), ("b", "z", 60, 12.05, 0.1), ("c", "z", 61, 12.2, 0.1)], "run_from string, run_to string, cell long, predicted double, sd double")
    m = rescore.mapped_ions(ions, curve).where("pep_key = 'k1'").first()
    assert [p.rt for p in m.predictions] == [12.0, 12.2]
    assert rescore.search_windows(rescore.mapped_ions(ions, curve), 0.3).first().reach == 0.3


def test_crosslinks(spark):
    a, b = 500.0, 800.0
    rows = [("r", i, m, 5.0, 2) for i, m in enumerate([a, a + crosslink.CORE, b, b + crosslink.CORE, a + b + crosslink.CORE])]
    c = spark.createDataFrame(rows, "run string, cluster_id long, mass double, apex_rt double, charge int")
    pairs = crosslink.mass_pairs(c, 10.0, 0.6)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(0, 1), (2, 3)]
    assert [(r.low, r.high, r.intact) for r in crosslink.intact(crosslink.pair_pairs(pairs, 0.6), c, 10.0, 0.6).collect()] == [(0, 2, 4)]
    spots = spark.createDataFrame([("f", "A01"), ("f", "A02"), ("f", "B01")], "feature string, spot string")
    assert sorted(r.length for r in crosslink.spot_runs(spots).collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("r", 5, "PEPK", 2, 400.5, 0.9, "P1")], "run string, scan_num long, sequence string, charge int, mass double, probability double, protein string")
    K.write_pepxml(hits, str(tmp_path / "x"))
    back = I.read_pepxml(spark, str(tmp_path / "x"), False).first()
    assert (back.sequence, back.probability, back.scan_num) == ("PEPK", 0.9, 5)
    df = spark.createDataFrame([(1, [2.0, 3.0])], "k int, mz array<double>")
    K.write_csv(K.wide_isotopes(df, ["mz"], 3), str(tmp_path / "c"), single=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["k", "mz1", "mz2", "mz3"]
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert K.checkpointed(make, str(tmp_path / "t"), spark).count() == 1
    assert len(calls) == 1


def test_streams(spark, tmp_path):
    from peakloom.streaming import windows as V

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "e"))
    e = V.read_events(spark, str(tmp_path / "e"))
    V.run_once(V.binned(e), "bins", "complete").count()
    total = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert spark.table("bins").agg(F.sum("n")).first()[0] == total
    assert V.run_once(V.running_targets(e), "targets", "update").agg(F.sum("n")).first()[0] == total


def test_user_modifications_and_keyed_sequences(spark, tmp_path):
    from peakloom.functions.exprs import modified_sequence
    from peakloom.operators import lookups as O

    path = put(tmp_path / "ptm.xml", '<ptms><ptm name="Mine" mass="12.5" residues="KR"/><ptm name="End" mass="1.0" residues="N-term"/></ptms>')
    assert sorted(tuple(r) for r in O.read_modifications(spark, path).collect()) == [("End", "N-term", 1.0), ("Mine", "K", 12.5), ("Mine", "R", 12.5)]
    df = spark.sql("select 'PEPK' as s, array(named_struct('position', 4, 'mass', 12.5D), named_struct('position', 1, 'mass', 2D)) as m")
    assert df.select(modified_sequence("s", "m")).first()[0] == "[2(P)]PEP[12.5(K)]K"


def test_pepxml_without_a_run_summary_reads_the_same(spark, tmp_path):
    q = '<spectrum_query spectrum="r.1.1.2" start_scan="1" precursor_neutral_mass="900" assumed_charge="2"><search_result><search_hit hit_rank="1" peptide="PEPK" protein="P" calc_neutral_pep_mass="900" massdiff="0"/></search_result></spectrum_query>'
    whole = put(tmp_path / "a.pepXML", f"<msms_pipeline_analysis><msms_run_summary>{q}</msms_run_summary></msms_pipeline_analysis>")
    bare = put(tmp_path / "b.pepXML", f"<msms_pipeline_analysis>{q}</msms_pipeline_analysis>")
    a, b = (I.read_pepxml(spark, x).drop("run").first() for x in (whole, bare))
    assert a == b and a.sequence == "PEPK"


def test_layouts(spark, tmp_path):
    from peakloom.sources import layouts as L

    assert L.names_of("clusters", 2)[7:11] == ["mz1", "mz2", "PeakIdx1", "PeakIdx2"] and len(L.names_of("psms")) == 22
    pairs = spark.createDataFrame([(1, 2, 0.9, 5.0)], "a long, b long, corr double, ppm double")
    c = spark.createDataFrame([(1, 800.0, 401.0, 2, 1.0, 2.0, [5.0]), (2, 912.1, 457.0, 2, 1.0, 2.0, [7.0])], "cluster_id long, mass double, mono_mz double, charge int, start_rt double, end_rt double, height array<double>")
    L.write_layout(L.crosslink_table(pairs, c), "crosslinks", str(tmp_path / "x"))
    r = spark.read.csv(str(tmp_path / "x"), sep="\t", header=True).first()
    assert (r.A_MW, r.B_MW, r.A_intensity, r.B_intensity, r.Corr) == ("800.0", "912.1", "5.0", "7.0", "0.9")


def test_unfragmented_and_raw_spectra(spark):
    p = Parameters(min_fragments=1)
    edges = spark.createDataFrame([("r", "w", c, 2, mz, 5.0, 100.0 + k, 10.0, 1.0) for c, mz in ((1, 410.0), (2, 500.0)) for k in range(3)], "run string, window_id string, cluster_id long, charge int, mono_mz double, apex_rt double, fragment_mz double, intensity double, corr double")
    clusters = spark.createDataFrame([("r", "w", 1, 410.0, [1.0, 2.0, 3.0]), ("r", "w", 2, 500.0, [1.0])], "run string, window_id string, cluster_id long, mono_mz double, mz array<double>")
    windows = spark.createDataFrame([("r", "w", 400.0, 425.0)], "run string, window_id string, window_lo double, window_hi double")
    s = extract.unfragmented_spectra(edges, clusters, windows, p).collect()
    assert [(r.tier, r.precursor_mz, len(r.peaks)) for r in s] == [("Q3", 410.0, 3)]
    points = spark.createDataFrame([("r", "w", n, 4.9 + n / 10, 100.0 + k, 3.0 * n) for n in (1, 3) for k in range(2)], "run string, window_id string, scan_num long, rt double, mz double, intensity double")
    raw = extract.raw_spectra(points, clusters.where("cluster_id = 1").selectExpr("run", "window_id", "cluster_id", "2 as charge", "mono_mz", "5.0D as apex_rt"), p).first()
    assert raw.tier == "raw" and [x.intensity for x in raw.peaks] == [3.0, 3.0]


def test_pairs_by_correlation_first(spark):
    """Of two partners the better correlated one, though the other is nearer in mass."""
    x = [float(k) / 10 for k in range(20)]
    up = [math.exp(-((v - 1) ** 2) / 0.1) for v in x]
    rows = [("r", 1, 1000.0, 1.0, 2, x, up), ("r", 2, 1000.0 + crosslink.CORE, 1.0, 2, x, up[::-1][:10] + [0.1 * k for k in range(10)]), ("r", 3, 1000.0 + crosslink.CORE + 0.002, 1.0, 2, x, [2 * v for v in up])]
    c = spark.createDataFrame(rows, "run string, cluster_id long, mass double, apex_rt double, charge int, rt array<double>, intensity array<double>")
    best = lambda n: crosslink.mass_pairs(c, 10.0, 1.0, n).where("a = 1").first().b
    assert best(None) == 2 and best(10.0) == 3
