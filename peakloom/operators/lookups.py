"""Smaller relational operators on scans, traces, peptides and proteins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import ppm
from . import joins as J
from . import windows as W

#: Common modifications (name, residues, mass difference in dalton).
MODIFICATIONS = [
    ("Oxidation", "M", 15.994915), ("Carbamidomethyl", "C", 57.021464), ("Phospho", "STY", 79.966331), ("Acetyl", "Kn", 42.010565), ("Deamidated", "NQ", 0.984016),
    ("Methyl", "KR", 14.01565), ("Dimethyl", "KR", 28.0313), ("GlyGly", "K", 114.042927), ("Gln->pyro-Glu", "Q", -17.026549), ("Glu->pyro-Glu", "E", -18.010565),
]
#: Enzymes (name, residues cut after, residue that prevents it).
ENZYMES = [("Trypsin", "KR", "P"), ("Lys-C", "K", "P"), ("Arg-C", "R", "P"), ("Glu-C", "DE", "P"), ("Chymotrypsin", "FWYL", "P")]


def modification_table(spark: SparkSession, extra: list[tuple[str, str, float]] = ()) -> DataFrame:
    """name, site, massdiff: a row a residue; `extra` adds a user's own."""
    return spark.createDataFrame([(n, s, m) for n, sites, m in [*MODIFICATIONS, *extra] for s in sites], "name string, site string, massdiff double")


def read_modifications(spark: SparkSession, path: str) -> DataFrame:
    """name, site, massdiff of a user's registry in XML: elements `ptm` with name, mass and residues; sites may be N-term and C-term."""
    schema = "_name string, _mass double, _residues string"
    m = spark.read.format("xml").option("rowTag", "ptm").schema(schema).load(path)
    sites = F.when(F.col("_residues").rlike("(?i)term$"), F.array("_residues")).otherwise(F.filter(F.split("_residues", ""), lambda x: x.rlike("[A-Z]")))
    return m.select(F.col("_name").alias("name"), F.explode(sites).alias("site"), F.col("_mass").alias("massdiff"))


def enzyme_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENZYMES, "enzyme string, cuts_after string, unless_before string")


def nearest_modification(found: DataFrame, table: DataFrame, within: float = 0.5) -> DataFrame:
    """found: site, massdiff, ... with the registered modification of that site nearest in mass, null beyond `within`."""
    t = F.broadcast(table.select(F.col("site").alias("_site"), F.col("massdiff").alias("_mass"), "name"))  # a registry of a few hundred rows
    key = [c for c in found.columns]
    j = found.join(t, (F.col("site") == F.col("_site")) & (F.abs(F.col("massdiff") - F.col("_mass")) < within), "left")
    return j.groupBy(*key).agg(F.min_by("name", F.struct(F.abs(F.col("massdiff") - F.col("_mass")), F.col("name"))).alias("modification"), F.min(F.abs(F.col("massdiff") - F.col("_mass"))).alias("distance"))


def parent_scan(scans: DataFrame) -> DataFrame:
    """Each scan with the nearest MS1 scan before it."""
    w = Window.partitionBy("run").orderBy("scan_num").rowsBetween(Window.unboundedPreceding, -1)
    return scans.withColumn("parent_scan", F.last(F.when(F.col("ms_level") == 1, F.col("scan_num")), ignorenulls=True).over(w))


def highest_peak(targets: DataFrame, peaks: DataFrame, tolerance: float) -> DataFrame:
    """targets: run, scan_num, target_mz, with the most intense peak within ppm of the same scan."""
    p = peaks.select("run", "scan_num", F.col("mz").alias("peak_mz"), "intensity")
    m = J.ppm_join(targets, p, "target_mz", "peak_mz", tolerance, ["run", "scan_num"])
    return m.groupBy("run", "scan_num", "target_mz").agg(F.max_by(F.struct("peak_mz", "intensity"), F.struct("intensity", -F.col("peak_mz"))).alias("b")).select("run", "scan_num", "target_mz", "b.*")


def inclusion_hits(peaks: DataFrame, inclusion: DataFrame, tolerance: float) -> DataFrame:
    """Peaks in a box of the inclusion list (i_mz, i_start, i_end), each once."""
    m = J.ppm_join(peaks, inclusion, "mz", "i_mz", tolerance).where(F.col("rt").between(F.col("i_start"), F.col("i_end")))
    return m.select(*peaks.columns).distinct()


def sequences_of(ids: DataFrame, fasta: DataFrame) -> DataFrame:
    """Sequence by exact accession, else of the least accession that contains the id."""
    from .containment import contained

    exact = ids.join(fasta.select(F.col("acc").alias("id"), "sequence"), "id", "left")
    missing = exact.where("sequence is null").select("id", F.col("id").alias("_text")).distinct()
    found = contained(fasta.select("acc", F.col("acc").alias("_t")), missing).groupBy("id").agg(F.min("acc").alias("acc"))
    fallback = found.join(fasta.select("acc", F.col("sequence").alias("_other")), "acc").select("id", "_other")
    return exact.join(fallback, "id", "left").select(*[c for c in exact.columns if c != "sequence"], F.coalesce("sequence", "_other").alias("sequence"))


def residue_context(prot_pep: DataFrame) -> DataFrame:
    """protein sequence and peptide -> the residues before and after its first occurrence (- at an end)."""
    p = F.expr("locate(peptide, protein)")
    before = F.when(p > 1, F.substring(F.col("protein"), p - 1, F.lit(1))).when(p == 1, "-")
    after = F.when(p > 0, F.coalesce(F.nullif(F.substring(F.col("protein"), p + F.length("peptide"), F.lit(1)), F.lit("")), F.lit("-")))
    return prot_pep.withColumn("before", before).withColumn("after", after)


def top_peaks(points: Column | str, n: int) -> Column:
    """The n most intense of an array of struct<mz, intensity>, by m/z."""
    points = F.col(points) if isinstance(points, str) else points
    by = F.sort_array(F.transform(points, lambda p: F.struct(p["intensity"].alias("i"), p["mz"].alias("m"))), asc=False)
    return F.array_sort(F.transform(F.slice(by, 1, n), lambda p: F.struct(p["m"].alias("mz"), p["i"].alias("intensity"))))


def baseline(points: DataFrame, by: list[str], y: str) -> DataFrame:
    """Mean of each group's lowest tenth."""
    w = Window.partitionBy(*by).orderBy(y)
    return points.withColumn("_tile", F.ntile(10).over(w)).where("_tile = 1").groupBy(*by).agg(F.avg(y).alias("baseline"))


def conflict(edges: DataFrame, least: float = 0.6) -> DataFrame:
    """Sum of the strong correlations that each fragment has with all precursors."""
    return edges.groupBy("run", "fragment_id").agg(F.sum(F.when(F.col("corr") > least, F.col("corr")).otherwise(0.0)).alias("conflict"))


def without_duplicates(fragments: DataFrame, by: list[str]) -> DataFrame:
    """Per key the row of the greatest intensity times correlation."""
    rest = [c for c in fragments.columns if c not in by]
    return W.best(fragments, by, F.struct(F.col("intensity") * F.col("corr"), *rest), rest)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of mean ranks."""
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    return df.select(*by, rank(x).alias("_x"), rank(y).alias("_y")).groupBy(*by).agg(F.corr("_x", "_y").alias("spearman"))


def spectrum_dot(a: DataFrame, b: DataFrame, width: float = 0.1) -> DataFrame:
    """Normalised dot product of two spectra sets by key and m/z bin: a, b: key, mz, intensity."""
    g = lambda d, n: d.groupBy("key", F.floor(F.col("mz") / width).alias("bin")).agg(F.max("intensity").alias(n))
    x, y = g(a, "x"), g(b, "y")
    norm = lambda d, n: d.groupBy("key").agg(F.sqrt(F.sum(F.col(n) * F.col(n))).alias(f"{n}n"))
    dot = x.join(y, ["key", "bin"]).groupBy("key").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    return dot.join(norm(x, "x"), "key").join(norm(y, "y"), "key").select("key", F.try_divide("d", F.col("xn") * F.col("yn")).alias("dot"))


def close_psms(psms: DataFrame, targets: DataFrame, tolerance: float, rt_tolerance: float) -> DataFrame:
    """PSMs by m/z, charge and time."""
    t = targets.select(F.col("mz").alias("t_mz"), F.col("rt").alias("t_rt"), "charge", "target_id")
    m = J.ppm_join(psms, t, "mz", "t_mz", tolerance, ["charge"])
    return m.where((F.abs(F.col("rt") - F.col("t_rt")) <= rt_tolerance) & (ppm("mz", "t_mz") <= tolerance))
