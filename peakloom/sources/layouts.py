"""Export layouts: tables with the column names and order that downstream tools read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import write_csv

#: Column names of the exports, in their order. A name that ends in # is repeated for isotopes 1, 2, ...
LAYOUTS = {
    "clusters": "Cluster_Index StartRT EndRT StartScan EndScan Identified Charge mz# PeakIdx# Corr# SNR# PeakHeight# PeakHeightRT# PeakArea# IsoMapProb ConflictCorr LeftInt RightInt NoRidges MS1Score MS1Prob MS1LProb",
    "psms": "SpecID Sequence ModSeq TPPModSeq Modification Charge mz NeutralPepMass ObservedMass RT AdjustedRT Rank ScanNo PreAA NextAA MissedCleavage ExpectValue MassError Prob Rawname ParentPepIndex MS1Quant",
    "pep_ions": "PepIndex Sequence ModSeq TPPModSeq IsNonDegenerate Charge mz IDRT PeakRT NoPSMs MS1ClusIndex MS2ClusIndex PeakScore PeakHeight1 PeakHeight2 PeakHeight3 PeakArea1 PeakArea2 PeakArea3",
    "mapped_ions": "PepIndex Sequence ModSeq TPPModSeq IsNonDegenerate Charge mz IDRT PeakRT NoPSMs MS1ClusIndex MS2ClusIndex PeakScore PeakHeight1 PeakHeight2 PeakHeight3 PeakArea1 PeakArea2 PeakArea3 ModInfo PredictRT MS1AlignmentProb MS1AlignmentLProb MS2AlignmentProb MS2AlignmentLProb",
    "proteins": "AccNo UniProtID ProteinLength ProteinGroup IndisProt Description Mass Score Peptides Sequence",
    "fragments": "PepIndex IonType fragMZ ObservedMZ Charge Intensity Correlation PPM ApexDelta RTOverlapP",
    "library": "Sequence ModSeq ModificationString Charge PrecursorMz MaxProbability MS1Score",
    "library_fragments": "PepKey IonType FragMz Corr PPM Intensity ApexDelta RTOverlapP",
    "scores": "Modseq PredictRT PrecursorMz Type ClusterRT MSLevel ApexDeltaScore CorrScore SpecDotProduct Rank UScore Probability",
    "crosslinks": "A_MW A_mz A_Charge A_startRT A_endRT A_intensity B_MW B_mz B_Charge B_startRT B_endRT B_intensity Corr ppm",
    "regions": "Cluster_Index StartRT EndRT mz Charge",
}
#: Layouts that are parted by tabs, all others by commas.
TABS = ("scores", "crosslinks", "regions")


def names_of(layout: str, isotopes: int = 3) -> list[str]:
    return [f"{n[:-1]}{k + 1}" if n.endswith("#") else n for n in LAYOUTS[layout].split() for k in range(isotopes if n.endswith("#") else 1)]


def laid_out(df: DataFrame, layout: str, isotopes: int = 3) -> DataFrame:
    """The layout's columns in its order; those that df lacks are empty."""
    have = set(df.columns)
    return df.select(*[F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names_of(layout, isotopes)])


def write_layout(df: DataFrame, layout: str, path: str, isotopes: int = 3, single: bool = False) -> None:
    write_csv(laid_out(df, layout, isotopes), path, "\t" if layout in TABS else ",", single)


def numbered(values: str, name: str, n: int) -> list[Column]:
    """An array as columns name1 to name<n>."""
    return [F.try_element_at(F.col(values), F.lit(k + 1)).alias(f"{name}{k + 1}") for k in range(n)]


def cluster_table(clusters: DataFrame, isotopes: int = 3) -> DataFrame:
    """cluster_id, start_rt, end_rt, charge, mz, height and, where there, corrs -> the layout `clusters`."""
    more = numbered("corrs", "Corr", isotopes) if "corrs" in clusters.columns else []
    return clusters.select(F.col("cluster_id").alias("Cluster_Index"), F.col("start_rt").alias("StartRT"), F.col("end_rt").alias("EndRT"), F.col("charge").alias("Charge"), *numbered("mz", "mz", isotopes), *numbered("height", "PeakHeight", isotopes), *more)


def psm_table(psms: DataFrame) -> DataFrame:
    """As `read_pepxml` gives them -> the layout `psms`."""
    same = {"SpecID": "spectrum", "Sequence": "sequence", "ModSeq": "mod_sequence", "TPPModSeq": "mod_sequence", "Charge": "charge", "NeutralPepMass": "mass", "ObservedMass": "observed_mass", "RT": "rt", "ScanNo": "scan_num", "MissedCleavage": "missed_cleavages", "ExpectValue": "expect", "Prob": "probability", "Rawname": "run"}
    return psms.select(*[F.col(b).alias(a) for a, b in same.items() if b in psms.columns], ((F.col("mass") + F.col("charge") * 1.00727) / F.col("charge")).alias("mz"), (F.col("observed_mass") - F.col("mass")).alias("MassError"), F.lit(1).alias("Rank"))


def ion_table(ions: DataFrame) -> DataFrame:
    """Peptide ions with pep_key, sequence, mod_sequence, charge, rt, psms and, where there, cluster_id and height -> `pep_ions` (and the shared columns of `mapped_ions`)."""
    same = {"PepIndex": "pep_key", "Sequence": "sequence", "ModSeq": "mod_sequence", "TPPModSeq": "mod_sequence", "Charge": "charge", "mz": "mz", "IDRT": "rt", "NoPSMs": "psms", "MS1ClusIndex": "cluster_id", "PeakRT": "c_apex", "PredictRT": "predicted_rt", "MS1AlignmentProb": "p_ms1", "MS2AlignmentProb": "p_ms2"}
    heights = numbered("height", "PeakHeight", 3) if "height" in ions.columns else []
    return ions.select(*[F.col(b).alias(a) for a, b in same.items() if b in ions.columns], *heights)


def protein_table(proteins: DataFrame) -> DataFrame:
    """acc, length, protein_group, indistinguishable, description, mass, score, peptides (arrays are joined by ;) and, where there, sequence -> `proteins`."""
    same = {"AccNo": "acc", "UniProtID": "uniprot", "ProteinLength": "length", "ProteinGroup": "protein_group", "IndisProt": "indistinguishable", "Description": "description", "Mass": "mass", "Score": "score", "Peptides": "peptides", "Sequence": "sequence"}
    return proteins.select(*[F.col(b).alias(a) for a, b in same.items() if b in proteins.columns])


def fragment_table(fragments: DataFrame) -> DataFrame:
    same = {"PepIndex": "pep_key", "IonType": "ion", "fragMZ": "mz", "ObservedMZ": "observed_mz", "Charge": "charge", "Intensity": "intensity", "Correlation": "corr", "PPM": "ppm", "ApexDelta": "apex_delta", "RTOverlapP": "overlap"}
    return fragments.select(*[F.col(b).alias(a) for a, b in same.items() if b in fragments.columns])


def score_table(hits: DataFrame) -> DataFrame:
    """Re-extraction hits, best first by score within a peptide -> `scores`."""
    same = {"Modseq": "mod_sequence", "PredictRT": "predicted_rt", "PrecursorMz": "precursor_mz", "Type": "role", "ClusterRT": "rt", "MSLevel": "ms_level", "ApexDeltaScore": "apex_delta", "CorrScore": "corr", "SpecDotProduct": "spec_dot", "Rank": "rank", "UScore": "score", "Probability": "local_p"}
    return hits.select(*[F.col(b).alias(a) for a, b in same.items() if b in hits.columns])


def crosslink_table(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs (a, b, corr, ppm) with both clusters' facts (cluster_id, mass, mono_mz, charge, start_rt, end_rt, height) -> `crosslinks`."""

    def side(name: str) -> DataFrame:
        facts = {"MW": "mass", "mz": "mono_mz", "Charge": "charge", "startRT": "start_rt", "endRT": "end_rt", "intensity": "height"}
        value = lambda b: F.try_element_at(F.col(b), F.lit(1)) if dict(clusters.dtypes)[b].startswith("array") else F.col(b)
        return clusters.select(F.col("cluster_id").alias(name.lower()), *[value(b).alias(f"{name}_{a}") for a, b in facts.items() if b in clusters.columns])

    return pairs.select("a", "b", F.col("corr").alias("Corr"), "ppm").join(side("A"), "a").join(side("B"), "b").drop("a", "b")


def peptide_rt_matrix(ions: DataFrame, runs: list[str]) -> DataFrame:
    """Time and first-isotope height of each peptide ion by run."""
    return ions.groupBy("pep_key").pivot("run", runs).agg(F.max("rt").alias("RT"), F.max(F.try_element_at("height", F.lit(1))).alias("MS1"))
