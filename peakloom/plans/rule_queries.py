"""Catalogue queries of the library's filters, lookups and smaller aggregates, each called as a user would, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import lookups as O
from ..operators import windows as W
from ..sources import layouts as L
from ..sources import sinks as K
from ..sources import spectra as R
from . import crosslink, extract, identify, quant, rescore
from .catalog import decoys, query, r4, t
from .params import Parameters


def order_scans(spark, sf):
    """Orders as scans: windows of 25 by price, level 1 where the order is finished."""
    o = t(spark, sf, "orders")
    lo = F.floor(F.col("o_totalprice") / 50_000) * 25 + 400.0
    return o.select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("scan_num"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("ms_level"), (F.col("o_custkey") / 8).alias("rt"), lo.alias("window_lo"), (lo + 25).alias("window_hi"), (F.col("o_totalprice") / 100).alias("mz"))


SCANS = "s AS (SELECT o_orderpriority AS run, o_orderkey AS scan_num, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS ms_level, o_custkey / 8.0::DOUBLE AS rt, floor(o_totalprice / 50000) * 25 + 400 AS window_lo, floor(o_totalprice / 50000) * 25 + 425 AS window_hi, o_totalprice / 100 AS mz FROM orders)"


@query(f"WITH {SCANS} SELECT run, scan_num, rt FROM s WHERE ms_level = 2 AND rt >= 3 AND rt <= 120 AND window_lo = 450 AND window_hi = 475")
def q70_scan_selection(spark, sf):
    return R.select_scans(order_scans(spark, sf), (2,), 3.0, 120.0, (450.0, 475.0)).select("run", "scan_num", "rt")


@query(f"WITH {SCANS} SELECT run, CAST(window_lo AS DOUBLE) AS window_lo, CAST(window_hi AS DOUBLE) AS window_hi, count(*) AS scans, min(rt) AS start_rt, max(rt) AS end_rt FROM s WHERE ms_level = 2 GROUP BY ALL")
def q71_isolation_windows(spark, sf):
    return R.isolation_windows(order_scans(spark, sf))


def in_band(mass: str, d: float = 0.1) -> str:
    up, low = f"(({mass}) * 0.00052738::DOUBLE + {0.066015 + d!r}::DOUBLE)", f"(({mass}) * 0.00042565::DOUBLE + {0.00038210 - d!r}::DOUBLE)"
    x = f"(({mass}) - floor({mass}))"
    u, w = f"({up} - floor({up}))", f"({low} - floor({low}))"
    return f"CASE WHEN {u} > {w} THEN {x} >= {w} AND {x} <= {u} ELSE {x} >= {w} OR {x} <= {u} END"


@query(
    f"""WITH a AS (SELECT o_orderkey, o_totalprice / 100 AS mz, z, z * (o_totalprice / 100 - 1.00727::DOUBLE) AS mass FROM orders, (SELECT unnest([2, 3, 4, 5]) AS z) c)
SELECT o_orderkey, CAST(z AS INTEGER) AS charge, {in_band('mass')} AS fits, ({in_band('1 * (mz - 1.00727::DOUBLE)')}) OR ({in_band('2 * (mz - 1.00727::DOUBLE)')}) AS fragment FROM a WHERE mass BETWEEN 600 AND 15000"""
)
def q72_mass_gates(spark, sf):
    """Charges that a precursor may have by its mass; whether each mass's fraction fits a peptide, and its m/z a fragment."""
    p = Parameters()
    o = t(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("mz"), F.explode(F.sequence(F.lit(p.charges[0]), F.lit(p.charges[1]))).alias("charge")).withColumn("mass", X.neutral_mass("mz", "charge"))
    return o.where(X.precursor_gate("mass", *p.mass_range)).select("o_orderkey", "charge", X.precursor_gate("mass", *p.mass_range, p.defect_offset).alias("fits"), X.fragment_fits("mz", p.defect_offset).alias("fragment"))


HITS = "h AS (SELECT l_partkey || '_' || l_suppkey % 3 AS pep_key, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'decoy' ELSE 'target' END AS role, l_discount * 2 AS local_p, l_tax * 12 AS p_ms2, l_quantity FROM lineitem)"


def line_hits(spark, sf):
    return t(spark, sf, "lineitem").select(X.ion_key("l_partkey", F.col("l_suppkey") % 3).alias("pep_key"), "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "decoy").otherwise("target").alias("role"), (F.col("l_discount") * 2).alias("local_p"), (F.col("l_tax") * 12).alias("p_ms2"), "l_quantity")


@query(f"WITH {HITS} SELECT pep_key, l_orderkey, l_linenumber, role FROM h WHERE pep_key IN (SELECT pep_key FROM h GROUP BY pep_key HAVING max(local_p) > 0.15)")
def q73_scored_matches(spark, sf):
    return rescore.scored_matches(line_hits(spark, sf), 0.15).select("pep_key", "l_orderkey", "l_linenumber", "role")


@query(f"WITH {HITS} SELECT pep_key, l_orderkey, l_linenumber FROM h WHERE greatest(local_p, p_ms2) >= 0.5")
def q74_probable_mapped(spark, sf):
    return identify.probable_mapped(line_hits(spark, sf).withColumnRenamed("local_p", "p_ms1"), 0.5).select("pep_key", "l_orderkey", "l_linenumber")


@query(
    f"""WITH {HITS}, lib AS (SELECT l_partkey || '_' || k AS pep_key, count(*) AS n FROM lineitem, (SELECT unnest([0, 1, 2, 3]) AS k) c GROUP BY ALL), i AS (SELECT pep_key, max(local_p) AS p FROM h GROUP BY pep_key)
SELECT lib.pep_key, n AS fragments, i.pep_key IS NOT NULL AS seen FROM lib LEFT JOIN i ON lib.pep_key = i.pep_key WHERE n >= 25 AND (p IS NULL OR p < 0.195)"""
)
def q75_library_to_search(spark, sf):
    """Library entries of enough fragments whose ion was found too weakly or not at all."""
    f = t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.collect_list("l_quantity").alias("fragments"))
    lib = f.select("fragments", F.explode(F.array(*map(F.lit, range(4)))).alias("k"), "l_partkey").select(X.ion_key("l_partkey", "k").alias("pep_key"), "fragments")
    hits = line_hits(spark, sf)
    ions = hits.withColumnRenamed("local_p", "probability")
    found = rescore.library_to_search(lib, ions, 0.195, 25)
    return found.join(hits.select("pep_key", F.lit(True).alias("seen")).distinct(), "pep_key", "left").select("pep_key", F.size("fragments").cast("long").alias("fragments"), F.coalesce("seen", F.lit(False)).alias("seen"))


WEIGHTS = "w AS (SELECT l_suppkey, l_partkey, max(l_discount) * 10 AS weight, min(l_discount) * 20 AS group_weight, max(l_tax) AS initial_probability FROM lineitem GROUP BY ALL)"


def weights(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg((F.max("l_discount") * 10).alias("weight"), (F.min("l_discount") * 20).alias("group_weight"), F.max("l_tax").alias("initial_probability")).select("*", F.concat(F.when(F.col("l_suppkey") % 4 == 0, "rev_").otherwise(""), F.lit("P"), F.col("l_suppkey").cast("string")).alias("acc"))


@query(f"WITH {WEIGHTS} SELECT l_suppkey, l_partkey, round(weight, 4) AS used_weight, false AS by_group FROM w WHERE weight >= 0.75 UNION ALL SELECT l_suppkey, l_partkey, round(group_weight, 4), true FROM w WHERE group_weight >= 0.75")
def q76_peptide_weights(spark, sf):
    """Peptides shared between proteins, by their own weight or their group's."""
    w = weights(spark, sf)
    one = lambda g: identify.weighted(w, 0.75, g).select("l_suppkey", "l_partkey", r4(F.col("used_weight")).alias("used_weight"), F.lit(g).alias("by_group"))
    return one(False).unionByName(one(True))


@query(
    f"""WITH {WEIGHTS}, p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'rev_' ELSE '' END || 'P' || s_suppkey AS acc, s_nationkey / 25.0::DOUBLE AS probability, (SELECT max(initial_probability) FROM w WHERE l_suppkey = s_suppkey) AS best FROM supplier)
SELECT acc, probability, best AS max_initial_probability FROM p WHERE probability >= 0.2 AND best >= 0.08 AND s_suppkey % 4 <> 0"""
)
def q77_probable_proteins(spark, sf):
    """Suppliers as proteins by local probability and their best peptide's, without decoys."""
    s = t(spark, sf, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 4 == 0, "rev_").otherwise(""), F.lit("P"), F.col("s_suppkey").cast("string")).alias("acc"), (F.col("s_nationkey") / 25).alias("probability"))
    return identify.probable_proteins(s, weights(spark, sf), 0.2, 0.08, "rev_").select("acc", "probability", "max_initial_probability")


@query(
    """WITH n AS (SELECT n_nationkey AS k, 400 + 20.0::DOUBLE * n_nationkey AS lo, 425 + 20.0::DOUBLE * n_nationkey AS hi FROM nation), c AS (SELECT o_orderkey, 400 + (o_custkey % 4000) / 8.0::DOUBLE AS mz FROM orders)
SELECT o_orderkey, min(lo) AS window_lo FROM c JOIN n ON mz BETWEEN lo AND hi GROUP BY o_orderkey"""
)
def q78_last_overlapping_window(spark, sf):
    """Nations as overlapping isolation windows: a cluster in an overlap counts in the lower one."""
    n = F.col("n_nationkey")
    w = t(spark, sf, "nation").select(F.lit("r").alias("run"), (400 + n * 20.0).alias("window_lo"), (425 + n * 20.0).alias("window_hi"))
    c = t(spark, sf, "orders").select(F.lit("r").alias("run"), "o_orderkey", (400 + (F.col("o_custkey") % 4000) / 8).alias("mono_mz"))
    return extract.last_window_only(c, w).select("o_orderkey", "window_lo")


@query(f"WITH {SCANS} SELECT run, scan_num, (SELECT max(b.scan_num) FROM s b WHERE b.run = a.run AND b.ms_level = 1 AND b.scan_num < a.scan_num) AS parent_scan FROM s a")
def q79_parent_scan(spark, sf):
    return O.parent_scan(order_scans(spark, sf)).select("run", "scan_num", "parent_scan")


@query(
    """WITH p AS (SELECT l_returnflag AS run, l_orderkey AS scan_num, l_partkey + 100.0::DOUBLE AS mz, l_extendedprice AS y FROM lineitem), x AS (SELECT DISTINCT run, scan_num, mz * 1.002::DOUBLE AS target FROM p)
SELECT a.run, a.scan_num, round(target, 4) AS target_mz, arg_max(mz, struct_pack(y := y, m := -mz)) AS peak_mz, max(y) AS intensity FROM x a JOIN p ON a.run = p.run AND a.scan_num = p.scan_num AND abs(target - mz) * 1e6 / mz <= 20000 GROUP BY a.run, a.scan_num, target"""
)
def q80_highest_peak(spark, sf):
    """The most intense peak within tolerance of each target of its scan."""
    p = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_orderkey").alias("scan_num"), (F.col("l_partkey") + 100.0).alias("mz"), F.col("l_extendedprice").alias("intensity"))
    targets = p.select("run", "scan_num", (F.col("mz") * 1.002).alias("target_mz")).distinct()
    return O.highest_peak(targets, p, 20_000.0).select("run", "scan_num", r4(F.col("target_mz")).alias("target_mz"), "peak_mz", "intensity")


@query(
    """WITH l AS (SELECT p_retailprice AS i_mz, p_size - 2.0::DOUBLE AS a, p_size + 2.0::DOUBLE AS b FROM part) SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem SEMI JOIN l ON abs(l_extendedprice / 50 - i_mz) * 1e6 / i_mz <= 60 AND l_quantity BETWEEN a AND b"""
)
def q81_inclusion_list(spark, sf):
    """Peaks in any box of mass and time of an inclusion list, each once."""
    boxes = t(spark, sf, "part").select(F.col("p_retailprice").alias("i_mz"), (F.col("p_size") - 2.0).alias("i_start"), (F.col("p_size") + 2.0).alias("i_end"))
    peaks = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 50).alias("mz"), F.col("l_quantity").alias("rt"))
    return O.inclusion_hits(peaks, boxes, 60.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()


@query(
    """WITH a AS (SELECT l_partkey AS key, floor(l_quantity / 4) AS bin, max(l_extendedprice) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_partkey AS key, floor(l_quantity / 4) AS bin, max(l_extendedprice) AS y FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
d AS (SELECT key, sum(a.y * b.y) AS d FROM a JOIN b USING (key, bin) GROUP BY key) SELECT key, round(d / (sqrt((SELECT sum(y * y) FROM a WHERE a.key = d.key)) * sqrt((SELECT sum(y * y) FROM b WHERE b.key = d.key))), 6) AS dot FROM d"""
)
def q82_spectrum_dot(spark, sf):
    """Normalised dot products of two sets of spectra by bins."""
    li = t(spark, sf, "lineitem")
    side = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("mz"), F.col("l_extendedprice").alias("intensity"))
    return O.spectrum_dot(side("R"), side("A"), 4.0).select("key", r4(F.col("dot"), 6).alias("dot"))


@query(
    """WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem)
SELECT l_suppkey, round(corr(x, y), 6) AS spearman FROM r GROUP BY l_suppkey"""
)
def q83_spearman(spark, sf):
    return O.spearman(t(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", r4(F.col("spearman"), 6).alias("spearman"))


@query("SELECT l_returnflag AS run, l_partkey AS fragment_id, round(sum(CASE WHEN l_discount > 0.06 THEN l_discount ELSE 0 END), 4) AS conflict FROM lineitem GROUP BY ALL")
def q84_conflict_scores(spark, sf):
    """Strong correlations of a fragment with all its precursors, added up."""
    e = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("fragment_id"), F.col("l_discount").alias("corr"))
    return O.conflict(e, 0.06).select("run", "fragment_id", r4(F.col("conflict")).alias("conflict"))


@query(
    """SELECT l_orderkey, l_returnflag, l_partkey, intensity, corr FROM (SELECT l_orderkey, l_returnflag, l_partkey, l_quantity AS intensity, l_discount AS corr, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity * l_discount DESC, l_partkey DESC, l_quantity DESC, l_discount DESC) AS n FROM lineitem) WHERE n = 1"""
)
def q85_without_duplicates(spark, sf):
    """Of a key's fragments the one of the greatest intensity times correlation."""
    f = t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey", F.col("l_quantity").alias("intensity"), F.col("l_discount").alias("corr"))
    return O.without_duplicates(f, ["l_orderkey", "l_returnflag"])


@query("SELECT l_suppkey, round(avg(l_extendedprice), 4) AS baseline FROM (SELECT *, ntile(10) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS n FROM lineitem) WHERE n = 1 GROUP BY l_suppkey")
def q86_baseline(spark, sf):
    return O.baseline(t(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice").select("l_suppkey", r4(F.col("baseline")).alias("baseline"))


@query(
    """WITH p AS (SELECT l_suppkey AS key, l_partkey AS m, max(l_extendedprice) AS y FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY y DESC, m DESC) AS n FROM p)
SELECT key, array_to_string(list(m ORDER BY m), ',') AS mz, round(sum(y), 2) AS intensity FROM r WHERE n <= 5 GROUP BY key"""
)
def q87_top_peaks(spark, sf):
    """The five most intense peaks of a scan, by m/z."""
    p = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("mz")).agg(F.max("l_extendedprice").alias("intensity")).groupBy("key").agg(F.collect_list(F.struct("mz", "intensity")).alias("points"))
    top = O.top_peaks("points", 5)
    return p.select("key", top.alias("t")).select("key", F.array_join(F.transform("t", lambda x: x["mz"].cast("string")), ",").alias("mz"), r4(F.aggregate(F.transform("t", lambda x: x["intensity"]), F.lit(0.0), lambda a, x: a + x), 2).alias("intensity"))


@query(
    """WITH a AS (SELECT d.doc_id, b.item_id, d.text AS t, b.text AS p, strpos(d.text, b.text) AS k FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '')
SELECT doc_id, item_id, CASE WHEN k > 1 THEN substr(t, k - 1, 1) ELSE '-' END AS before, CASE WHEN k + length(p) > length(t) THEN '-' ELSE substr(t, k + length(p), 1) END AS after FROM a"""
)
def q88_residue_context(spark, sf):
    """What stands before and after a peptide's first place in each protein that holds it."""
    from ..operators.containment import contained

    d, b = t(spark, sf, "documents").select("doc_id", "text"), t(spark, sf, "benchmark").where("text <> ''").select("item_id", "text")
    both = contained(d, b).join(d.withColumnRenamed("text", "protein"), "doc_id").join(b.withColumnRenamed("text", "peptide"), "item_id")
    return O.residue_context(both).select("doc_id", "item_id", "before", "after")


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS mz, l_quantity AS rt, CAST(l_linenumber % 3 AS INTEGER) AS z FROM lineitem), x AS (SELECT o_orderkey AS target_id, o_totalprice AS mz, o_custkey % 50 AS rt, CAST(o_orderkey % 3 AS INTEGER) AS z FROM orders)
SELECT l_orderkey, l_linenumber, target_id, count(*) AS pairs FROM p JOIN x ON p.z = x.z AND abs(p.mz - x.mz) * 1e6 / x.mz <= 30 AND abs(p.rt - x.rt) <= 2 GROUP BY ALL"""
)
def q89_close_psms(spark, sf):
    """PSMs by m/z, charge and time of targets."""
    p = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("rt"), (F.col("l_linenumber") % 3).cast("int").alias("charge"))
    x = t(spark, sf, "orders").select(F.col("o_orderkey").alias("target_id"), F.col("o_totalprice").alias("mz"), (F.col("o_custkey") % 50).cast("double").alias("rt"), (F.col("o_orderkey") % 3).cast("int").alias("charge"))
    return O.close_psms(p, x, 30.0, 2.0).groupBy("l_orderkey", "l_linenumber", "target_id").agg(F.count("*").alias("pairs"))


@query(
    """WITH p AS (SELECT DISTINCT l_suppkey AS spot, l_partkey / 2.0::DOUBLE AS mz FROM lineitem) SELECT a.spot, a.mz AS m, b.mz AS mate FROM p a JOIN p b ON a.spot = b.spot AND abs(a.mz + 112.0995 - b.mz) <= 0.7"""
)
def q90_maldi_pairs(spark, sf):
    """Masses of one spot that lie the linker's core apart."""
    p = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("spot"), (F.col("l_partkey") / 2).alias("mz")).distinct()
    return crosslink.maldi_pairs(p).select("spot", "m", "mate")


@query(
    """WITH s AS (SELECT DISTINCT o_custkey AS feature, chr(CAST(65 + o_orderkey % 8 AS INTEGER)) AS r, o_orderkey // 8 % 24 + 1 AS c FROM orders), n AS (SELECT feature, (ascii(r) - 65) * 24 + c AS n FROM s),
g AS (SELECT feature, n, n - dense_rank() OVER (PARTITION BY feature ORDER BY n) AS island FROM n) SELECT feature, CAST(min(n) AS INTEGER) AS first, count(*) AS length FROM g GROUP BY feature, island"""
)
def q91_spot_runs(spark, sf):
    """Consecutive spots of a plate that hold a feature."""
    k = F.col("o_orderkey")
    s = t(spark, sf, "orders").select(F.col("o_custkey").alias("feature"), F.concat(F.char((65 + k % 8).cast("int")), F.lpad((F.floor(k / 8) % 24 + 1).cast("string"), 2, "0")).alias("spot")).distinct()
    return crosslink.spot_runs(s).select("feature", "first", "length")


@query(
    """WITH g AS (SELECT p_partkey, CASE WHEN p_size < 15 THEN 'rev_P' ELSE 'P' END || p_partkey AS acc, CASE WHEN p_size % 2 = 0 THEN 'rev_Q' ELSE 'Q' END || p_partkey AS q, CASE WHEN p_size % 3 = 0 THEN 'rev_R' ELSE 'R' END || p_partkey AS r FROM part)
SELECT p_partkey, CASE WHEN NOT starts_with(acc, 'rev_') THEN acc WHEN NOT starts_with(q, 'rev_') THEN q WHEN NOT starts_with(r, 'rev_') THEN r ELSE acc END AS acc FROM g"""
)
def q92_fixed_heads(spark, sf):
    """A decoy at a group's head gives way to its first target."""
    name = lambda c, x: F.concat(F.when(c, f"rev_{x}").otherwise(x), F.col("p_partkey").cast("string"))
    size = F.col("p_size")
    p = t(spark, sf, "part").select("p_partkey", name(size < 15, "P").alias("acc"), F.array(name(size % 2 == 0, "Q"), name(size % 3 == 0, "R")).alias("indistinguishable"))
    return identify.fixed_heads(p, "rev_").select("p_partkey", "acc")


@query(
    """WITH e AS (SELECT l_orderkey, l_linenumber AS k, max(l_quantity) AS y FROM lineitem GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS r FROM e), f AS (SELECT l_orderkey, count(*) AS isotopes, max(CASE WHEN k = 1 THEN y END) AS mono FROM g WHERE k = r GROUP BY l_orderkey)
SELECT l_orderkey, isotopes, mono, isotopes >= 3 AS complete FROM f"""
)
def q93_isotopes_to_the_first_gap(spark, sf):
    """Isotopes of a cluster up to the first that is missing, and whether the first three are there."""
    e = t(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg(F.max("l_quantity").alias("y"))
    f = W.first_missing_prefix(e, ["l_orderkey"], "k").groupBy("l_orderkey").agg(F.count("*").alias("isotopes"), F.max(F.when(F.col("k") == 1, F.col("y"))).alias("mono"), F.array_sort(F.collect_list("y")).alias("mz"))
    return f.select("l_orderkey", "isotopes", "mono", X.complete_isotopes("mz", 3).alias("complete"))


@query(
    """SELECT l_partkey AS pep_key, count(DISTINCT l_returnflag || l_linestatus) AS ion_types, round(var_pop(l_extendedprice / 1000), 4) AS mz_variance, count(DISTINCT l_suppkey) AS proteins FROM lineitem GROUP BY l_partkey"""
)
def q94_ion_types_and_spread(spark, sf):
    """Kinds of fragment ions, spread of m/z and number of proteins of each peptide."""
    li = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("pep_key"), F.concat("l_returnflag", "l_linestatus").alias("ion_type"), (F.col("l_extendedprice") / 1000).alias("mz"), F.col("l_suppkey").alias("acc"), F.col("l_partkey").alias("sequence"))
    proteins = identify.protein_ions(li.select("pep_key", "sequence").distinct(), li).groupBy("pep_key").agg(F.count("*").alias("proteins"))
    spread = extract.mz_variance(li, ["pep_key"]).select("pep_key", r4(F.col("mz_variance")).alias("mz_variance"))
    return identify.ion_types(li).join(spread, "pep_key").join(proteins, "pep_key")


@query(
    """SELECT l_partkey AS sequence, array_to_string(list(DISTINCT l_partkey || '_' || l_linenumber ORDER BY l_partkey || '_' || l_linenumber), ';') AS pep_keys FROM lineitem GROUP BY l_partkey"""
)
def q95_keys_by_sequence(spark, sf):
    i = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("sequence"), X.ion_key("l_partkey", "l_linenumber").alias("pep_key"))
    return identify.keys_by_sequence(i).select("sequence", F.array_join("pep_keys", ";").alias("pep_keys"))


@query(
    """WITH g AS (SELECT *, l_returnflag AS run, l_partkey * 10 AS mz FROM lineitem), s AS (SELECT run, min(mz) AS low, max(l_quantity + 1) - min(l_quantity) AS span FROM g GROUP BY run), b AS (SELECT g.*, ceil((mz - low) / 1000.0::DOUBLE) AS bin, span FROM g JOIN s USING (run)),
c AS (SELECT run, bin, count(*) AS cover FROM b GROUP BY ALL) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, run FROM b JOIN c USING (run, bin) WHERE cover <= 6 * span"""
)
def q96_without_contaminants(spark, sf):
    """Traces in m/z bins that are not covered for most of the run."""
    c = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("run"), (F.col("l_partkey") * 10).alias("target_mz"), F.col("l_quantity").alias("start_rt"), (F.col("l_quantity") + 1).alias("end_rt"))
    return extract.without_contaminants(c, 6.0, 1000.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "run")


@query(
    """WITH e AS (SELECT l_suppkey AS cluster_id, l_partkey AS fragment_id, max(l_discount) AS corr, max(l_quantity) AS y FROM lineitem GROUP BY ALL), m AS (SELECT a.cluster_id, a.fragment_id, max(struct_pack(c := b.corr, i := b.y)) AS best FROM e a JOIN e b ON a.cluster_id = b.cluster_id AND abs((2500 + 2 * 1.00727 - a.fragment_id) - b.fragment_id) * 1e6 / b.fragment_id <= 2000 AND b.fragment_id > 0 AND 2500 + 2 * 1.00727 - a.fragment_id > 0 GROUP BY ALL)
SELECT e.cluster_id, e.fragment_id, best IS NOT NULL AS complementary, CASE WHEN coalesce(best.c > corr, false) THEN greatest(y, best.i) ELSE y END AS intensity, CASE WHEN coalesce(best.c > corr, false) THEN best.c ELSE corr END AS corr FROM e LEFT JOIN m ON e.cluster_id = m.cluster_id AND e.fragment_id = m.fragment_id"""
)
def q97_complementary_fragments(spark, sf):
    """Fragments whose masses add up to the precursor's take the better one's correlation and intensity."""
    e = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("fragment_id")).agg(F.max("l_discount").alias("corr"), F.max("l_quantity").alias("intensity"))
    e = e.select(F.lit("r").alias("run"), F.lit("w").alias("window_id"), "cluster_id", "fragment_id", F.lit(2500.0).alias("mass"), F.col("fragment_id").cast("double").alias("fragment_mz"), "corr", "intensity")
    return extract.boosted(e, Parameters(ms2_ppm=2000.0)).select("cluster_id", "fragment_id", "complementary", "intensity", "corr")


@query(
    """WITH i AS (SELECT s_suppkey AS acc, s_nationkey % 5 AS run, s_acctbal AS value FROM supplier), b AS (SELECT r_regionkey AS run, r_name AS bait, r_regionkey % 2 = 0 AS control FROM region)
SELECT 'bait' AS kind, CAST(run AS BIGINT) AS run, bait, CASE WHEN control THEN 'C' ELSE 'T' END AS prey, CAST(NULL AS DOUBLE) AS value FROM b UNION ALL SELECT 'prey', NULL, NULL, CAST(acc AS VARCHAR), NULL FROM i WHERE value > 0
UNION ALL SELECT 'interaction', i.run, bait, CAST(acc AS VARCHAR), value FROM i JOIN b ON i.run = b.run WHERE value > 0"""
)
def q98_interaction_tables(spark, sf):
    """Baits, preys and their interactions for interaction scoring."""
    a = t(spark, sf, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("run"), F.col("s_suppkey").cast("string").alias("acc"), F.col("s_name").alias("gene"), F.lit(100).alias("length"), F.col("s_acctbal").alias("value"))
    b = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("run"), F.col("r_name").alias("bait"), (F.col("r_regionkey") % 2 == 0).alias("control"))
    baits, preys, inter = K.interaction_tables(a, b)
    null = F.lit(None)
    one = baits.select(F.lit("bait").alias("kind"), "run", "bait", F.col("kind").alias("prey"), null.cast("double").alias("value"))
    two = preys.select(F.lit("prey").alias("kind"), null.cast("long").alias("run"), null.cast("string").alias("bait"), F.col("acc").alias("prey"), null.cast("double").alias("value"))
    return one.unionByName(two).unionByName(inter.select(F.lit("interaction").alias("kind"), "run", "bait", F.col("acc").alias("prey"), "value"))


@query(
    f"""WITH i AS (SELECT l_returnflag AS run, l_partkey AS sequence, CAST(l_linenumber % 2 + 2 AS INTEGER) AS z, max(l_discount) AS p FROM lineitem GROUP BY ALL), a AS (SELECT DISTINCT sequence, z FROM i)
SELECT sequence, z AS charge, row_number() OVER (PARTITION BY sequence ORDER BY z) AS index, (SELECT count(*) FROM i WHERE i.sequence = a.sequence AND i.z = a.z) AS runs FROM a"""
)
def q99_dense_index(spark, sf):
    """Numbers from 1 for the ions of each peptide, and the runs that hold them."""
    i = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("sequence"), (F.col("l_linenumber") % 2 + 2).cast("int").alias("charge"))
    return W.dense_index(i.groupBy("sequence", "charge").agg(F.countDistinct("run").alias("runs")), ["sequence"], [F.asc("charge")]).select("sequence", "charge", F.col("index").cast("long").alias("index"), "runs")
