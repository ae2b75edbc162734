"""PSMs to peptide ions and proteins, with target-decoy thresholds, and their link to clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import at
from ..functions import exprs as X
from ..operators import joins as J
from ..operators import windows as W
from ..operators.containment import contained


def peptide_ions(psms: DataFrame, tag: str) -> DataFrame:
    """One row per run, modified sequence and charge."""
    p = psms.withColumn("pep_key", X.ion_key("mod_sequence", "charge"))
    return p.groupBy("run", "pep_key", "sequence", "mod_sequence", "charge").agg(
        F.max("probability").alias("probability"), F.max_by("observed_mass", F.struct("probability", "spectrum")).alias("mass_at_best"), F.countDistinct("spectrum").alias("psms"), F.avg("rt").alias("rt"), F.stddev_pop("rt").alias("rt_sd"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("parent_proteins")))).alias("parent_proteins"),
    ).withColumn("decoy", X.all_decoys("parent_proteins", tag))


def filtered_ions(ions: DataFrame, fdr: float) -> DataFrame:
    """Ions of all runs by one threshold on their best probability over runs."""
    best = ions.groupBy("pep_key").agg(F.max("probability").alias("probability"), F.min("decoy").alias("decoy"))
    kept = W.fdr_filter(best, "probability", "decoy", "pep_key", fdr).select("pep_key")
    return ions.join(kept, "pep_key", "left_semi")


def r_factor(proteins: DataFrame, below: float) -> DataFrame:
    low = F.col("probability") < below
    return proteins.agg(F.try_divide(F.count_if(~F.col("decoy") & low).cast("double"), F.count_if(F.col("decoy") & low)).alias("r_factor"))


def proteins_from(ions: DataFrame, fasta: DataFrame) -> DataFrame:
    """acc, sequence of the peptides that occur in each protein."""
    found = contained(fasta.select("acc", F.col("sequence").alias("text")), ions.select(F.col("sequence").alias("peptide"), "sequence").distinct())
    return found.select("acc", F.col("peptide").alias("sequence"))


def max_initial_probability(prot_pep: DataFrame) -> DataFrame:
    return prot_pep.groupBy("acc").agg(F.max("initial_probability").alias("max_initial_probability"))


def fixed_heads(proteins: DataFrame, tag: str) -> DataFrame:
    """A decoy at a group's head gives way to the first indistinguishable target."""
    target = at(F.filter("indistinguishable", lambda x: ~(x.startswith(tag) | x.endswith(tag))), 1)
    return proteins.withColumn("acc", F.when(X.is_decoy("acc", tag), F.coalesce(target, F.col("acc"))).otherwise(F.col("acc")))


def psm_clusters(psms: DataFrame, scan_map: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of the pseudo spectra that PSMs come from; scan_map: run, tier, n, cluster_id."""
    hit = psms.join(scan_map.withColumnRenamed("n", "scan_num"), ["run", "tier", "scan_num"])
    return hit.join(clusters, ["run", "cluster_id"])


def clusters_near(ions: DataFrame, clusters: DataFrame, ppm: float, rt_tolerance: float) -> DataFrame:
    """Clusters by mass, charge and time; those that hold the time strictly come first, others count only if there is none."""
    c = clusters.select("run", "cluster_id", "charge", F.col("mass").alias("c_mass"), F.col("apex_rt").alias("c_apex"), F.col("start_rt").alias("c_start"), F.col("end_rt").alias("c_end"), "height")
    m = J.ppm_join(ions, c, "mass", "c_mass", ppm, ["run", "charge"]).where((F.col("rt") >= F.col("c_start") - rt_tolerance) & (F.col("rt") <= F.col("c_end") + rt_tolerance))
    return J.tight_first(m, ["run", "pep_key"], (F.col("rt") > F.col("c_start")) & (F.col("rt") < F.col("c_end")))


def quantified(ions: DataFrame, clusters: DataFrame, ppm: float, rt_tolerance: float) -> DataFrame:
    """The highest cluster of each ion."""
    m = clusters_near(ions, clusters, ppm, rt_tolerance).withColumn("_h", at("height", 1))
    return m.groupBy("run", "pep_key").agg(F.max_by(F.struct("cluster_id", "height", "c_apex"), F.struct("_h", "cluster_id")).alias("b")).select("run", "pep_key", "b.*")


def split_runs(psms: DataFrame) -> DataFrame:
    """Run names of a pooled set, from the spectra."""
    return psms.withColumn("run", X.run_name("spectrum"))


def probable_mapped(ions: DataFrame, least: float) -> DataFrame:
    """Mapped ions whose better alignment probability (p_ms1, p_ms2) reaches `least`."""
    return ions.where(X.targeted_probability("p_ms1", "p_ms2") >= least)


def weighted(prot_pep: DataFrame, least: float, by_group: bool = False) -> DataFrame:
    """Peptides of proteins whose weight (the group's with by_group) reaches `least`, with it as `used_weight`."""
    w = F.col("group_weight" if by_group else "weight")
    return prot_pep.withColumn("used_weight", w).where(w >= least)


def probable_proteins(proteins: DataFrame, prot_pep: DataFrame, local: float, initial: float, tag: str, keep_decoys: bool = False) -> DataFrame:
    """Proteins by local probability and by their best peptide's initial probability; decoys by the tag only with keep_decoys."""
    best = max_initial_probability(prot_pep)
    kept = proteins.join(best, "acc").where((F.col("probability") >= local) & (F.col("max_initial_probability") >= initial))
    return kept if keep_decoys else kept.where(~X.is_decoy("acc", tag))


def keys_by_sequence(ions: DataFrame) -> DataFrame:
    """sequence, pep_keys: the ions of each peptide in order."""
    return ions.groupBy("sequence").agg(F.array_sort(F.collect_set("pep_key")).alias("pep_keys"))


def ion_types(fragments: DataFrame) -> DataFrame:
    """pep_key, ion_types: how many kinds of fragment ions each peptide ion has."""
    return fragments.groupBy("pep_key").agg(F.countDistinct("ion_type").alias("ion_types"))


def protein_ions(ions: DataFrame, prot_pep: DataFrame) -> DataFrame:
    """Distinct peptide ions of proteins."""
    return ions.join(prot_pep.select("acc", "sequence").distinct(), "sequence").select("acc", "pep_key").distinct()
