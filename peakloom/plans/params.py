"""Parameters of the pipelines. The defaults of the usual time-of-flight setting."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Parameters:
    ms1_ppm: float = 30.0
    ms2_ppm: float = 40.0
    min_snr: float = 2.0
    min_mz: float = 200.0
    missed_scans: int = 1
    min_points: int = 1
    charges: tuple[int, int] = (2, 5)
    isotopes: tuple[int, int] = (2, 4)
    mass_range: tuple[float, float] = (600.0, 15000.0)
    apex_delta: float = 0.6
    overlap: float = 0.1
    corr: float = 0.1
    high_corr: float = 0.7
    high_corr_edges: int = 10
    iso_corr: float = 0.2
    iso_pattern: float = 0.3
    precursor_rank: int = 25
    fragment_rank: int = 300
    min_fragments: int = 10
    defect_offset: float = 0.1
    defect_filter: bool = True
    symmetry: float = 0.3
    smooth_factor: int = 5
    max_rt_range: float = 1.5
    rt_tolerance: float = 0.5
    weights: dict = field(default_factory=lambda: {"spec_dot": 25.0, "corr": -2.0, "ppm": 4.0, "apex_delta": -2.0, "overlap": 1.0, "precursor_corr": 1.0, "rt_diff": 0.1, "precursor_ppm": 1.0, "precursor_isotope": 1.0, "sum_ppm_corr": 5.0})
