"""Writers. Directories of part files, written by the tasks; `single` makes one file of a small result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", single: bool = False) -> None:
    """Arrays are joined by ; and structs left out by the caller."""
    flat = df.select(*[F.concat_ws(";", F.col(c).cast("array<string>")).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).csv(path, sep=sep)


def wide_isotopes(clusters: DataFrame, arrays: list[str], n: int) -> DataFrame:
    """Array columns as numbered columns."""
    return clusters.select(*[c for c in clusters.columns if c not in arrays], *[F.try_element_at(a, F.lit(k + 1)).alias(f"{a}{k + 1}") for a in arrays for k in range(n)])


def mgf_text(spectra: DataFrame) -> DataFrame:
    """tier, value: one text block a spectrum. spectra: run, tier, spectrum_id, charge, precursor_mz, rt, peaks array<struct<mz, intensity>>."""
    number = F.row_number().over(Window.partitionBy("run", "tier").orderBy("spectrum_id"))
    s = spectra.withColumn("n", number)
    title = F.format_string("%s.%d.%d.%d", "run", "n", "n", "charge")
    lines = F.array_join(F.transform(F.array_sort("peaks"), lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))), "\n")
    body = F.concat(F.lit("BEGIN IONS\nPEPMASS="), F.col("precursor_mz").cast("string"), F.lit("\nCHARGE="), F.col("charge").cast("string"), F.lit("+\nRTINSECONDS="), (F.col("rt") * 60).cast("string"), F.lit("\nTITLE="), title, F.lit("\n"), lines, F.lit("\nEND IONS\n"))
    return s.select("tier", "run", "n", "spectrum_id", body.alias("value"))


def write_mgf(spectra: DataFrame, path: str) -> DataFrame:
    """Text partitioned by tier; returns the bridge from spectrum number to spectrum_id."""
    t = mgf_text(spectra)
    t.select("tier", "value").write.mode("overwrite").partitionBy("tier").text(path)
    return t.select("run", "tier", "n", "spectrum_id")


def read_bridge(bridge: DataFrame, path: str) -> DataFrame:
    """run, tier, scan_num, spectrum_id from the mapping beside an MGF folder, written there first if it isn't yet. Numbers are those of the titles, so none has to be moved when runs are put together."""
    at = f"{path}_mapping"
    done = checkpointed(lambda: bridge, at, bridge.sparkSession)
    return done.select("run", "tier", F.col("n").cast("long").alias("scan_num"), "spectrum_id")


def write_pepxml(hits: DataFrame, path: str) -> None:
    """run, scan_num, sequence, charge, mass, probability, protein -> spectrum queries."""
    q = hits.select(
        F.format_string("%s.%d.%d.%d", "run", "scan_num", "scan_num", "charge").alias("_spectrum"), F.col("scan_num").alias("_start_scan"), F.col("charge").alias("_assumed_charge"), F.col("mass").alias("_precursor_neutral_mass"),
        F.struct(F.struct(F.lit(1).alias("_hit_rank"), F.col("sequence").alias("_peptide"), F.col("protein").alias("_protein"), F.struct(F.lit("peptideprophet").alias("_analysis"), F.struct(F.col("probability").alias("_probability")).alias("peptideprophet_result")).alias("analysis_result")).alias("search_hit")).alias("search_result"),
    )
    q.write.mode("overwrite").format("xml").option("rowTag", "spectrum_query").option("rootTag", "msms_run_summary").save(path)


def checkpointed(make, path: str, spark):
    """The table at path if a finished one is there, else make() written there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_matrix(df: DataFrame, key: list[str], run: str, runs: list[str], values: dict) -> DataFrame:
    """One row a key, one group of columns a run; null where a run lacks the key."""
    return df.groupBy(*key).pivot(run, runs).agg(*[e.alias(n) for n, e in values.items()])


def interaction_tables(abundance: DataFrame, baits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bait, prey and interaction tables; abundance: run, acc, gene, length, value; baits: run, bait, control."""
    present = abundance.where("value > 0")
    return baits.select("run", "bait", F.when(F.col("control"), "C").otherwise("T").alias("kind")), present.select("acc", "length", "gene").distinct(), present.join(baits, "run").select("run", "bait", "acc", "value")
