import math
import random

import numpy as np
import pytest

from peakloom.functions import models as M
from peakloom.functions import sequences as Q
from peakloom.functions import signal as S


def test_trace_statistics():
    t = S.traced(np.array([0, 1]), np.array([500.0, 500.01]), np.array([10.0, 20.0]), np.array([1.0, 2.0]), np.array([1.0, 1.0]), 30)
    assert len(t) == 1 and t[0]["target_mz"] == pytest.approx(500.008) and t[0]["apex_rt"] == 2.0 and t[0]["snr"] == 20


@pytest.mark.parametrize("seed", range(40))
def test_islands_trace_like_the_whole(seed):
    rng = random.Random(seed)
    ppm, lanes = 20.0, [500.0]
    for _ in range(5):
        lanes.append(lanes[-1] * (1 + rng.uniform(1.5, 6) * ppm * 1e-6))
    rows = [(s, m * (1 + rng.gauss(0, 4e-6)), rng.uniform(5, 100)) for s in range(25) for m in lanes if rng.random() < 0.6]
    scan, mz, y = (np.array(x) for x in zip(*rows))
    rts, bg = np.arange(25) * 0.1, np.ones(25)
    key = lambda ts: sorted((round(t["target_mz"], 7), t["n_points"], round(t["apex_rt"], 3)) for t in ts)
    whole = key(S.traced(scan, mz, y, rts, bg, ppm))
    order = np.argsort(mz)
    cuts = np.nonzero(np.diff(mz[order]) * 1e6 / mz[order][1:] > ppm)[0] + 1
    parts = [t for own in np.split(order, cuts) for t in S.traced(scan[own], mz[own], y[own], rts, bg, ppm)]
    assert key(parts) == whole


def test_centroids_and_groups():
    mz, y = S.centroids(np.array([100.0, 100.001, 100.002, 200.0]), np.array([1.0, 5.0, 2.0, 3.0]), 17000)
    assert mz.tolist() == [100.001, 200.0] and y.tolist() == [5.0, 3.0]
    m, i = np.array([500.0, 500.50168, 501.00335]), np.array([10.0, 6.0, 2.0])
    assert S.isotope_groups(m, i, range(1, 4), 20) == [(2, [0, 1, 2])]
    one, _ = S.deisotoped(m, i, range(1, 4), 20)
    assert one == pytest.approx([2 * (500 - 1.00727) + 1.00727])
    assert S.constant_background(np.array([3.0, 1.0, 2.0, 2.0])) == 2.0


def test_smoothing_and_regions():
    x = np.linspace(0, 4, 60)
    y = np.exp(-((x - 1) ** 2) / 0.05) * 100 + np.exp(-((x - 3) ** 2) / 0.05) * 80
    sx, sy = S.bspline(x, y, 120)
    assert sx[0] == x[0] and sx[-1] == pytest.approx(x[-1]) and sy.max() <= y.max() + 1e-9
    parts = S.regions(sx, sy, [5, 7, 9])
    tops = [a for _, a, _ in parts if sy[np.abs(sx - a).argmin()] > 20]
    assert len(tops) == 2 and tops[0] == pytest.approx(1, abs=0.1) and tops[1] == pytest.approx(3, abs=0.1)
    assert sum(len(p) for p in S.separated(x, y, parts)) <= len(x)


def test_coelution():
    t = np.linspace(0, 2, 60)
    a, b = np.exp(-((t - 1) ** 2) / 0.1) * 10 + 0.1, np.exp(-((t - 1) ** 2) / 0.1) * 50 + 0.5
    assert S.coelution(t, a, t, b, 60) == pytest.approx(1, abs=1e-6)
    assert S.coelution(t, t + 1, t, 4 - t, 60) == 0
    assert S.coelution(t[:8], a[:8], t[:8], b[:8], 60) == 0


def test_fits():
    slope, b, r2 = S.fitted([1, 2, 3], [2, 4.1, 5.9])
    assert (slope, b, r2) == pytest.approx((1.95, 0.1, 0.998031), abs=1e-6)
    assert S.isotope_fit([1, 0.5, 0.2], [1, 0.6, 0.2]) == pytest.approx(0.980199, abs=1e-6)
    assert S.upper_gamma(0.5, 0.5) == pytest.approx(math.erfc(math.sqrt(0.5)))
    x = np.linspace(0, 30, 200)
    assert S.loess(x, 2 * x + 1, np.array([5.0, 20.0])) == pytest.approx([11, 41])
    g, y, sd = S.local_curve(x, 2 * x + 1, 3.0)
    assert np.abs(y - 2 * g - 1).max() < 1e-9 and sd.max() < 1e-6
    assert S.dot_product([3, 4], [1, 2]) == pytest.approx(0.983870, abs=1e-6) and S.contrast_angle([3, 4], [1, 2]) == pytest.approx(0.885502, abs=1e-6)
    assert S.binned(np.array([100.025]), np.array([8.0])) == pytest.approx({1000: 6.0, 1001: 2.0})


def test_models():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 500), rng.normal(6, 1, 500)])
    w, m, s = M.gaussians(x)
    assert sorted(m) == pytest.approx([0, 6], abs=0.3)
    grid = np.linspace(-6, 12, 2000)
    assert M.density(x, grid).sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=0.02)
    t = M.posterior_table(x, rng.normal(0, 1, 500), rng.normal(6, 1, 100))
    assert np.interp(6, t["score"], t["local_p"]) > 0.9 and np.interp(0, t["score"], t["local_p"]) < 0.4
    good, bad = rng.normal(1, 1, (200, 3)), rng.normal(0, 1, (200, 3))
    weights, rest = M.iterated_discriminant(good, bad)
    assert (good @ weights).mean() > (bad @ weights).mean() and len(rest) == 100
    assert M.iterated_discriminant(good[:4], bad) is None


def test_sequences():
    assert Q.digest("MAAAAAAAKRPBBBBBBBK", 0, 3, 50) == ["MAAAAAAAK", "AAAAAAAK", "RPBBBBBBBK"]
    ions = {(n, z): m for n, z, m in Q.fragments("PEPTIDE")}
    assert ions[("b2", 1)] == pytest.approx(227.10263, abs=1e-4) and ions[("y1", 1)] == pytest.approx(148.06043, abs=1e-4)
    d = Q.shuffled("PEPTIDEKAGVLLER")
    assert [i for i, c in enumerate("PEPTIDEKAGVLLER") if c in "KRP"] == [i for i, c in enumerate(d[: len("PEPTIDEKAGVLLE")] + d[-1]) if c in "KRP"] and Q.shuffled("PEPTIDEKAGVLLER") == d
    assert Q.modified("PEP[80]TIDE", "[16]", 4, False) == "PEP[80]T[16]IDE" and Q.modifications("PEP[80]T") == [(3, "P", 80.0)]


@pytest.mark.parametrize("seed", range(10))
def test_alignment_is_symmetric(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randrange(3, 15))) for _ in range(2))
    for local in (False, True):
        s, x, y = Q.aligned(a, b, local=local)
        assert s == pytest.approx(Q.aligned(b, a, local=local)[0])
        assert len(x) == len(y) and (local or (x.replace("-", ""), y.replace("-", "")) == (a, b))


def test_background_by_hand():
    """Ten points of falling isotopes have the least level; noise that outnumbers them twice raises it; few or flat points have none."""
    mz = np.arange(10) * 1.0 + 400
    falling = np.linspace(100, 10, 10)
    assert S.background_level(mz, falling) == 10.0
    assert S.background_level(mz[:9], falling[:9]) == 0.0 and S.background_level(mz, np.full(10, 5.0)) == 0.0
    noisy = np.concatenate([mz, 600 + np.arange(20) * 0.1])
    y = np.concatenate([falling + 100, np.linspace(2, 3, 20)])
    # levels from 2 to the 22nd of 30 heights, 120; at 2 there are 18 noise gaps against 8 isotopes, one step above none
    assert S.background_level(noisy, y) == pytest.approx(2 + (120 - 2) / 20)


def test_substitution_matrix():
    from peakloom.functions import sequences as Q

    assert len(Q.PAIRS) == 210 and Q.pair_score("W", "W") == 11 and Q.pair_score("I", "V") == Q.pair_score("V", "I") == 3 and Q.pair_score("P", "W") == -4
    assert Q.similarity("PEPTIDEK", "PEPTIDEK") == 1.0 and Q.similarity("PEPTIDEK", "PWWWWWWK") < 0.5
    decoy = Q.shuffled("ACDEFGHIKLMNPQR")
    assert [decoy[i] for i in (8, 12)] == ["K", "P"] and Q.similarity("ACDEFGHIKLMNPQR", decoy) < 0.7
