"""Peptide and protein abundances and matrices over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows as W
from ..sources.sinks import run_matrix


def fragment_scores(fragments: DataFrame, runs: int, freq: float) -> DataFrame:
    """Fragments over runs; peptides whose fragments are all too rare keep them as a fallback."""
    s = fragments.where("corr > 0.6 and mz >= 200").groupBy("pep_key", "frag_key").agg(F.sum(F.col("corr") * F.col("intensity")).alias("score"), F.countDistinct("run").alias("seen"))
    good = s.where(F.col("seen") > runs * freq)
    return good.unionByName(s.join(good.select("pep_key").distinct(), "pep_key", "left_anti"))


def peptide_abundance(fragments: DataFrame, selected: DataFrame, top: int) -> DataFrame:
    """Sum over the selected fragments of each run's peptide."""
    chosen = W.top_k(selected.where("score > 0"), ["pep_key"], [F.desc("score"), F.asc("frag_key")], top)
    return fragments.join(chosen.select("pep_key", "frag_key"), ["pep_key", "frag_key"], "left_semi").groupBy("run", "pep_key").agg(F.sum("intensity").alias("abundance"))


def protein_abundance(peptides: DataFrame, prot_pep: DataFrame, top: int, min_weight: float) -> DataFrame:
    """Sum over each protein's best peptides over all runs."""
    p = peptides.join(prot_pep.where(F.col("weight") >= min_weight).select("acc", "pep_key").distinct(), "pep_key")
    s = p.groupBy("acc", "pep_key").agg(F.sum("abundance").alias("score"))
    chosen = W.top_k(s.where("score > 0"), ["acc"], [F.desc("score"), F.asc("pep_key")], top).select("acc", "pep_key")
    return p.join(chosen, ["acc", "pep_key"], "left_semi").groupBy("run", "acc").agg(F.sum("abundance").alias("abundance"))


def ibaq(heights: DataFrame, prot_pep: DataFrame, theoretical: DataFrame) -> DataFrame:
    """Summed monoisotopic heights over the number of theoretical peptides."""
    return heights.join(prot_pep.select("acc", "pep_key").distinct(), "pep_key").groupBy("run", "acc").agg(F.sum("height").alias("h")).join(theoretical, "acc").select("run", "acc", F.try_divide("h", "n_theoretical").alias("ibaq"))


def protein_matrix(abundance: DataFrame, runs: list[str]) -> DataFrame:
    return run_matrix(abundance, ["acc"], "run", runs, {"abundance": F.sum("abundance"), "n": F.count(F.lit(1))})


def counts(ions: DataFrame, proteins: DataFrame) -> DataFrame:
    return ions.groupBy("run").agg(F.count("*").alias("ions"), F.countDistinct("sequence").alias("peptides")).join(proteins.groupBy("run").agg(F.countDistinct("acc").alias("proteins")), "run", "left")
