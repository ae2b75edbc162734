"""Column builders for masses, keys and strings of mass-spectrometry tables.

Spark compares NaN as largest and divides under ANSI rules; builders guard logarithms and divisions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masses in dalton.
PROTON, WATER, HYDROGEN = 1.00727, 18.0105647, 1.0078250
C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def at(array: C, k: int) -> Column:
    """The k-th element from 1 (from the end if negative), null where there is none."""
    return F.try_element_at(col(array), F.lit(k))


def ppm(a: C, b: C) -> Column:
    """Distance in parts per million of b (not symmetric)."""
    return F.abs(col(a) - col(b)) * 1e6 / col(b)


def signed_ppm(a: C, b: C) -> Column:
    return (col(a) - col(b)) * 1e6 / col(b)


def shifted_mz(mz: C, charge: C, by: C, proton: float = PROTON) -> Column:
    """m/z after moving the neutral mass by ppm; a positive value lowers it."""
    by = by if isinstance(by, Column) else F.lit(by)
    mass = col(charge) * (col(mz) - proton)
    return (mass - mass * by / 1e6) / col(charge) + proton


def neutral_mass(mz: C, charge: C, proton: float = PROTON) -> Column:
    return col(charge) * (col(mz) - proton)


def mz_of_mass(mass: C, charge: C, proton: float = PROTON) -> Column:
    return col(mass) / col(charge) + proton


def isotope_mz(mz: C, charge: C, k: int, step: float = PROTON) -> Column:
    return col(mz) + F.lit(k * step) / col(charge)


def mass_defect(mass: C) -> Column:
    return col(mass) - F.floor(col(mass))


#: Slope and offset of the upper and lower bound of a peptide's mass defect.
UPPER, LOWER = (0.00052738, 0.066015), (0.00042565, 0.00038210)


def in_defect_range(mass: C, d: float) -> Column:
    """Whether the fractional mass lies between the bounds widened by d; the interval may wrap at 1."""
    m = col(mass)
    up, low = (mass_defect(m * s + o) for s, o in ((UPPER[0], UPPER[1] + d), (LOWER[0], LOWER[1] - d)))
    x = mass_defect(m)
    return F.when(up > low, (x >= low) & (x <= up)).otherwise((x >= low) | (x <= up))


def overlap_of_second(a_lo: C, a_hi: C, b_lo: C, b_hi: C) -> Column:
    """Share of B's range that A covers; 1 where A covers B."""
    shared = F.least(col(a_hi), col(b_hi)) - F.greatest(col(a_lo), col(b_lo))
    covers = (col(a_lo) <= col(b_lo)) & (col(a_hi) >= col(b_hi))
    return F.when(covers, F.lit(1.0)).when(shared > 0, shared / (col(b_hi) - col(b_lo))).otherwise(0.0)


def overlap_of_first(a_lo: C, a_hi: C, b_lo: C, b_hi: C) -> Column:
    """Share of A's range that B covers; 1 where B covers A."""
    return overlap_of_second(b_lo, b_hi, a_lo, a_hi)


def safe_ln(x: C) -> Column:
    """Natural logarithm, minus infinity at 0 and below."""
    return F.when(col(x) > 0, F.ln(col(x))).otherwise(F.lit(float("-inf")))


def targeted_probability(a: C, b: C) -> Column:
    return F.greatest(col(a), col(b))


def ion_key(sequence: C, charge: C) -> Column:
    return F.concat_ws("_", col(sequence), col(charge).cast("string"))


def run_name(raw: C) -> Column:
    """Text before the first dot."""
    return F.substring_index(col(raw), ".", 1)


def is_decoy(name: C, tag: str) -> Column:
    return col(name).startswith(tag) | col(name).endswith(tag)


def all_decoys(names: C, tag: str) -> Column:
    """True for an empty list."""
    return F.forall(col(names), lambda x: x.startswith(tag) | x.endswith(tag))


def missed_cleavages(sequence: C) -> Column:
    """K or R before another residue that is not P."""
    return F.regexp_count(col(sequence), F.lit("[KR](?=[^P])"))


def gene_name(description: C) -> Column:
    return F.regexp_extract(col(description), r"GN=(\S+)", 1)


def uniprot_id(accession: C) -> Column:
    return F.regexp_extract(col(accession), r"^\w+\|([^|]+)\|", 1)


def modifications(text: C) -> Column:
    """name(site);... -> array of struct<name, site>."""
    parts = F.filter(F.split(col(text), ";"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(.*)\(([^()]*)\)$", 1).alias("name"), F.regexp_extract(x, r"^(.*)\(([^()]*)\)$", 2).alias("site")))


def modification_text(mods: C) -> Column:
    return F.concat_ws(";", F.transform(col(mods), lambda m: F.concat(m["name"], F.lit("("), m["site"], F.lit(")"))))


def modification_key(mass: C, site: C) -> Column:
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", col(mass)), "0+$", ""), r"\.$", "")
    return F.concat(F.lit("["), number, F.lit("("), col(site), F.lit(")]"))


def isotope_error_corrected(diff: C) -> Column:
    """The mass difference's nearest of 0, 1, 2, 3 subtracted as -k; null if none is within 0.5."""
    k = F.floor(F.abs(col(diff)) + 0.5)
    near = F.least(k, F.lit(3))
    return F.when(F.abs(F.abs(col(diff)) - near) < 0.5, -near.cast("int"))


def relative_heights(heights: C) -> Column:
    return F.when(at(col(heights), 1) > 0, F.transform(col(heights), lambda h: h / at(col(heights), 1)))


def complete_isotopes(mz: C, least: int) -> Column:
    return (F.size(col(mz)) >= least) & F.forall(F.slice(col(mz), 1, least), lambda x: x > 0)


def nth_largest(values: C, n: int) -> Column:
    """-1 where there are ten values or fewer."""
    return F.when(F.size(col(values)) > 10, at(F.sort_array(col(values), asc=False), n)).otherwise(-1.0)


def weighted_score(weights: list[float], parts: C) -> Column:
    return F.aggregate(F.zip_with(F.lit(weights), col(parts), lambda w, s: w * s), F.lit(0.0), lambda a, x: a + x)


def sub_range(points: C, lo: float, hi: float) -> Column:
    """Points struct<x, y> within [lo, hi]."""
    return F.filter(col(points), lambda p: (p["x"] >= lo) & (p["x"] <= hi))


def time_tag(ts: Column | None = None) -> Column:
    return F.date_format(ts if ts is not None else F.current_timestamp(), "yyyyMMdd_HHmmss")


def precursor_gate(mass: C, lo: float, hi: float, defect: float | None = None) -> Column:
    """Whether a neutral mass lies in the range and, with a defect offset, its fraction in the peptides' band."""
    inside = col(mass).between(lo, hi)
    return inside if defect is None else inside & in_defect_range(mass, defect)


def fragment_fits(mz: C, defect: float) -> Column:
    """Whether the fraction fits a peptide fragment's at charge 1 or 2."""
    return in_defect_range(neutral_mass(mz, F.lit(1)), defect) | in_defect_range(neutral_mass(mz, F.lit(2)), defect)


def to_base_peak(points: C) -> Column:
    """struct<x, y> points with heights relative to the greatest, unchanged where that is 0 or less."""
    top = F.array_max(F.transform(col(points), lambda p: p["y"]))
    return F.transform(col(points), lambda p: F.struct(p["x"].alias("x"), F.when(top > 0, p["y"] / top).otherwise(p["y"]).alias("y")))


def closest_point(points: C, x: C) -> Column:
    """The point nearest to x, of two the lower one; null of none."""
    ranked = F.transform(col(points), lambda p: F.struct(F.abs(p["x"] - col(x)).alias("d"), p["x"].alias("x"), p["y"].alias("y")))
    best = F.array_min(ranked)
    return F.when(best.isNotNull(), F.struct(best["x"].alias("x"), best["y"].alias("y")))


def neighbours(points: C, x: C) -> Column:
    """The last point at or below x and the first above it."""
    return F.struct(F.array_max(F.filter(col(points), lambda p: p["x"] <= col(x))).alias("lower"), F.array_min(F.filter(col(points), lambda p: p["x"] > col(x))).alias("higher"))


def points_in_time(rt: C, intensity: C, lo: C, hi: C) -> Column:
    """Of two arrays the points with lo <= rt <= hi, as struct<rt, intensity>."""
    return F.filter(F.transform(F.arrays_zip(col(rt).alias("rt"), col(intensity).alias("intensity")), lambda p: F.struct(p["rt"].alias("rt"), p["intensity"].alias("intensity"))), lambda p: p["rt"].between(col(lo), col(hi)))


def modified_sequence(sequence: C, mods: C) -> Column:
    """The sequence with each modification's key put before its residue. mods: array of struct<position (from 1), mass>; several of one residue in order of mass."""
    letters = F.filter(F.split(col(sequence), ""), lambda x: x != "")
    keys = lambda i: F.array_join(F.transform(F.array_sort(F.filter(col(mods), lambda m: m["position"] == i + 1)), lambda m: modification_key(m["mass"], F.substring(col(sequence), m["position"], F.lit(1)))), "")
    return F.array_join(F.transform(letters, lambda c, i: F.concat(keys(i), c)), "")
