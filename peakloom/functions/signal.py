"""Numerical kernels on one scan, trace or pair of traces. Plain numpy; callers run them per batch or group."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np


def centroids(mz: np.ndarray, intensity: np.ndarray, resolution: float, min_mz: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """One peak per run of points closer than m/z / resolution: the most intense point of the run. The last run counts too."""
    keep = (mz >= min_mz) & (intensity > 0)
    mz, intensity = mz[keep], intensity[keep]
    if not len(mz):
        return mz, intensity
    run = np.concatenate([[0], np.cumsum(np.diff(mz) > mz[1:] / resolution)])
    order = np.lexsort((mz, -intensity, run))
    first = order[np.concatenate([[True], run[order][1:] != run[order][:-1]])]
    return mz[first], intensity[first]


#: Spacings of isotope peaks for charges 1 to 4 (both ends open), the spacing below which a pair is noise, and how often noise may outnumber isotopes.
SPACINGS, NOISE_GAP, NOISE_RATIO = ((0.95, 1.05), (0.45, 0.55), (0.30, 0.36), (0.24, 0.26)), 0.23, 2.0


def background_level(mz: np.ndarray, intensity: np.ndarray, steps: int = 20, share: float = 0.7, least: int = 10) -> float:
    """The least level, in `steps` from the least intensity to the one at `share` of the sorted ones, at which neighbouring peaks above it that are spaced like falling isotopes are more than half as many as those too close together; the last one if none is.

    Scans of fewer than `least` points, or without spread, have none (0). The first point of a scan is not looked at. One pass of the neighbours a level.
    """
    if len(mz) < least:
        return 0.0
    rising = np.sort(intensity)
    low, top = float(rising[0]), float(rising[int(len(rising) * share)])
    if top <= low + 0.001:
        return 0.0
    for level in low + (top - low) / steps * np.arange(steps):
        above = np.nonzero(intensity[1:] > level)[0] + 1
        gap, falls = np.diff(mz[above]), intensity[above][:-1] > intensity[above][1:]
        isotopes = sum(int((falls & (gap > a) & (gap < b)).sum()) for a, b in SPACINGS)
        if (gap < NOISE_GAP).sum() < NOISE_RATIO * isotopes:
            return float(level)
    return top


def constant_background(intensity: np.ndarray) -> float:
    """The least intensity that occurs twice; 0 if none does."""
    x = np.sort(intensity)
    same = np.nonzero(x[1:] == x[:-1])[0]
    return float(x[same[0]]) if len(same) else 0.0


def isotope_groups(mz: np.ndarray, intensity: np.ndarray, charges: range, ppm: float, step: float = 1.00335) -> list[tuple[int, list[int]]]:
    """(charge, peak numbers) of runs of equally spaced peaks with falling intensity, from high charge to low; a peak belongs to one group."""
    used, out = np.zeros(len(mz), bool), []
    for z in sorted(charges, reverse=True):
        for a in range(len(mz)):
            if used[a]:
                continue
            group = [a]
            while True:
                want = mz[group[-1]] + step / z
                lo, hi = bisect_left(mz, want * (1 - ppm * 1e-6)), bisect_right(mz, want * (1 + ppm * 1e-6))
                near = [b for b in range(lo, hi) if not used[b] and intensity[b] <= intensity[group[-1]]]
                if not near:
                    break
                group.append(max(near, key=lambda b: intensity[b]))
            if len(group) > 1:
                used[group] = True
                out.append((z, group))
    return out


def deisotoped(mz: np.ndarray, intensity: np.ndarray, charges: range, ppm: float, proton: float = 1.00727) -> tuple[np.ndarray, np.ndarray]:
    """Each group as one peak at charge 1 with its first intensity; other peaks unchanged."""
    groups = isotope_groups(mz, intensity, charges, ppm)
    rest = np.ones(len(mz), bool)
    out = []
    for z, g in groups:
        rest[g] = False
        out.append((z * (mz[g[0]] - proton) + proton, intensity[g[0]]))
    out += list(zip(mz[rest], intensity[rest]))
    out.sort()
    return np.array([m for m, _ in out]), np.array([i for _, i in out])


def preprocessed(mz, intensity, resolution=17000.0, min_mz=0.0, centroid=True, estimate_background=True, background=0.0, deisotope=False, charges=range(1, 5), ppm=30.0):
    """Centroid, background, denoise, deisotope; returns peaks and the background used."""
    mz, intensity = np.asarray(mz, float), np.asarray(intensity, float)
    if centroid:
        mz, intensity = centroids(mz, intensity, resolution, min_mz)
    level = max(background, background_level(mz, intensity)) if estimate_background else background
    keep = intensity > level
    mz, intensity = mz[keep], intensity[keep]
    if deisotope:
        mz, intensity = deisotoped(mz, intensity, charges, ppm)
    return mz, intensity, level


def traced(scan: np.ndarray, mz: np.ndarray, intensity: np.ndarray, rts: np.ndarray, backgrounds: np.ndarray, ppm: float, missed: int = 1, fill: bool = True) -> list[dict]:
    """m/z traces over scans. scan: number on the axis `rts`; all scans of the axis count, with peaks or not.

    Peaks seed traces in scan order, then by m/z, unless claimed. A scan gives the most intense unclaimed
    peak within ppm of the running target (intensity-squared mean of m/z); everything unclaimed in that
    window is claimed. A trace ends after `missed` + 1 scans in a row without a peak.
    """
    peaks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    order = np.lexsort((mz, scan))
    scan, mz, intensity = scan[order], mz[order], intensity[order]
    starts = np.searchsorted(scan, np.arange(len(rts) + 1))
    for s in np.unique(scan).tolist():
        a, b = starts[s], starts[s + 1]
        if b > a:
            peaks[s] = (mz[a:b], intensity[a:b], np.zeros(b - a, bool))
    out = []
    for s in sorted(peaks):
        m, i, claimed = peaks[s]
        for k in range(len(m)):
            if claimed[k]:
                continue
            first = rts[s - 1] if s else rts[s] - 0.01
            top, stop = k, k
            claimed[k] = True
            while stop + 1 < len(m) and abs(m[stop + 1] - m[k]) * 1e6 / m[k] <= ppm:  # same-scan neighbours are one peak
                stop += 1
                if not claimed[stop]:
                    claimed[stop] = True
                    if i[stop] >= i[top]:
                        top = stop
            points = [(first, m[k], backgrounds[s]), (rts[s], m[top], i[top])]
            weight, moment = i[top] ** 2, m[top] * i[top] ** 2
            gap, last = 0, s
            for n in range(s + 1, len(rts)):
                last = n
                target = moment / weight
                hit = None
                if n in peaks:
                    pm, pi, pc = peaks[n]
                    lo, hi = np.searchsorted(pm, target * (1 - ppm * 1.01e-6)), np.searchsorted(pm, target * (1 + ppm * 1.01e-6), "right")
                    for q in range(lo, hi):
                        if not pc[q] and abs(pm[q] - target) * 1e6 / target <= ppm:
                            pc[q] = True
                            if hit is None or pi[q] > pi[hit]:
                                hit = q
                if hit is None:
                    gap += 1
                    if fill:
                        points.append((rts[n], target, backgrounds[n]))
                    if gap > missed:
                        break
                else:
                    gap = 0
                    points.append((rts[n], pm[hit], pi[hit]))
                    weight += pi[hit] ** 2
                    moment += pm[hit] * pi[hit] ** 2
            target = moment / weight
            points.append((rts[last], target, backgrounds[last]))
            x = np.array(points)
            apex = int(np.argmax(x[:, 2]))
            low = x[:, 2].min()
            out.append({"target_mz": target, "apex_rt": x[apex, 0], "apex_intensity": x[apex, 2], "start_rt": x[0, 0], "end_rt": x[-1, 0], "n_points": len(x), "snr": x[apex, 2] / low if low > 0 else np.inf, "rt": x[:, 0], "mz": x[:, 1], "intensity": x[:, 2]})
    return out


def bspline(x: np.ndarray, y: np.ndarray, n: int, degree: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The clamped uniform B-spline of the control points, at n parameters (Cox-de Boor)."""
    m = len(x)
    if m <= degree or n < 2:
        return np.asarray(x, float), np.asarray(y, float)
    knots = np.concatenate([np.zeros(degree), np.linspace(0, 1, m - degree + 1), np.ones(degree)])
    u = np.linspace(0, 1, n)
    base = ((u[:, None] >= knots[:-1]) & (u[:, None] < knots[1:])).astype(float)
    base[-1] = 0
    base[-1, m - 1] = 1
    for d in range(1, degree + 1):
        width = len(knots) - 1 - d
        left, right = knots[d : d + width] - knots[:width], knots[d + 1 : d + 1 + width] - knots[1 : 1 + width]
        a = np.where(left > 0, (u[:, None] - knots[:width]) / np.where(left > 0, left, 1), 0)
        b = np.where(right > 0, (knots[d + 1 : d + 1 + width] - u[:, None]) / np.where(right > 0, right, 1), 0)
        base = a * base[:, :width] + b * base[:, 1 : width + 1]
    return base @ np.asarray(x, float), base @ np.asarray(y, float)


def resampled(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    grid = np.linspace(x[0], x[-1], n)
    return grid, np.interp(grid, x, y)


#: Fixed value: the factor that normalises the Mexican hat.
HAT = 0.8673250705840776


def hat_transform(y: np.ndarray, scale: int, window: float = 0.3) -> np.ndarray:
    """Continuous wavelet coefficients at one scale, negatives set to 0."""
    t = np.arange(-5 * scale, 5 * scale + 1) * window / scale / 0.3
    kernel = HAT * (1 - t**2) * np.exp(-(t**2) / 2) / np.sqrt(scale)
    return np.maximum(np.convolve(y, kernel[::-1], "full")[5 * scale : 5 * scale + len(y)], 0)


def ridges(y: np.ndarray, scales: list[int]) -> list[int]:
    """Places of local maxima that persist from the widest scale to the finest in which they appear."""
    found: list[int] = []
    for s in sorted(scales, reverse=True):
        c = hat_transform(y, s)
        peaks = [i for i in range(1, len(c) - 1) if c[i] > 0 and c[i] >= c[i - 1] and c[i] > c[i + 1]]
        moved = []
        for f in found:
            near = [p for p in peaks if abs(p - f) <= s]
            moved.append(min(near, key=lambda p: abs(p - f)) if near else f)
        found = moved + [p for p in peaks if all(abs(p - f) > s for f in moved)]
    return sorted(set(found))


def regions(x: np.ndarray, y: np.ndarray, scales: list[int], symmetry: float = 0.3) -> list[tuple[float, float, float]]:
    """(start, apex, end) of elution regions: ridges parted at valleys, a part split again while its sides differ little in depth against their ridges."""
    tops = ridges(y, scales) or [int(np.argmax(y))]
    valleys = [0, *[a + int(np.argmin(y[a : b + 1])) for a, b in zip(tops, tops[1:])], len(y) - 1]

    def parted(lo: int, hi: int) -> list[tuple[int, int]]:
        for cut in range(lo + 1, hi):
            left, right = max(y[tops[lo:cut]]), max(y[tops[cut:hi]])
            rise = abs(y[valleys[cut]] - y[valleys[lo]]) / left < symmetry and abs(y[valleys[hi]] - y[valleys[cut]]) / right < symmetry if left > 0 and right > 0 else False
            if rise:
                return parted(lo, cut) + parted(cut, hi)
        return [(lo, hi)]

    out = []
    for lo, hi in parted(0, len(tops)):
        a, b = valleys[lo], valleys[hi]
        out.append((float(x[a]), float(x[a + int(np.argmax(y[a : b + 1]))]), float(x[b])))
    return out


def separated(rt: np.ndarray, intensity: np.ndarray, parts: list[tuple[float, float, float]], widest: float = np.inf, least: int = 3) -> list[np.ndarray]:
    """Numbers of the raw points in each region (the first that holds them), cut to the widest around the apex; regions of fewer points are dropped."""
    taken, out = np.zeros(len(rt), bool), []
    for start, apex, end in parts:
        lo, hi = (start, end) if end - start <= widest else (apex - widest / 2, apex + widest / 2)
        mine = np.nonzero((rt >= lo) & (rt <= hi) & ~taken)[0]
        taken[mine] = True
        if len(mine) >= least:
            out.append(mine)
    return out


def coelution(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, points_per_min: float) -> float:
    """R squared of two traces binned in time, if they rise together and share six bins; else 0."""
    n, width = max(len(ax), len(bx)) // 2, 2.0 / points_per_min
    start = max(ax[0], bx[0]) if len(ax) and len(bx) else 0.0
    if n < 6:
        return 0.0
    both = []
    for x, y in ((ax, ay), (bx, by)):
        v = np.zeros(n)
        k = np.floor((np.asarray(x) - start) / width).astype(int)
        ok = (k >= 0) & (k < n)
        np.maximum.at(v, k[ok], np.asarray(y, float)[ok])
        for i in range(1, n - 1):  # a gap takes the mean of its filled left and raw right neighbour
            if v[i] == 0:
                v[i] = (v[i - 1] + v[i + 1]) / 2
        both.append(v)
    a, b = both
    shared = (a > 0) & (b > 0)
    if shared.sum() < 6:
        return 0.0
    slope, _, r2 = fitted(a[shared], b[shared])
    return r2 if slope > 0 else 0.0


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and R squared of least squares."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    dx, dy = x - x.mean(), y - y.mean()
    sxx, syy = float(dx @ dx), float(dy @ dy)
    if sxx == 0:
        return 0.0, float(y.mean()), 0.0
    slope = float(dx @ dy) / sxx
    residual = dy - slope * dx
    return slope, float(y.mean() - slope * x.mean()), 1 - float(residual @ residual) / syy if syy else 0.0


def local_curve(x: np.ndarray, y: np.ndarray, reach: float, step: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid, prediction and deviation: a line plus the mean residual within `reach`, twice that where there are fewer than ten points."""
    slope, b, _ = fitted(x, y)
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    residual = y - slope * x - b
    sums, squares = np.concatenate([[0], np.cumsum(residual)]), np.concatenate([[0], np.cumsum(residual**2)])
    grid = np.arange(x[0] - 1, x[-1] + 1 + step, step)
    mean, sd = np.zeros(len(grid)), np.zeros(len(grid))
    for w in (reach, 2 * reach):
        lo, hi = np.searchsorted(x, grid - w), np.searchsorted(x, grid + w, "right")
        n = hi - lo
        few = n < 10 if w != reach else np.ones(len(grid), bool)
        todo = few & (mean == 0) & (n > 10 if w != reach else n >= 10)
        m = np.divide(sums[hi] - sums[lo], n, out=np.zeros(len(grid)), where=n > 0)
        v = np.divide(squares[hi] - squares[lo], n, out=np.zeros(len(grid)), where=n > 0) - m**2
        mean[todo], sd[todo] = m[todo], np.sqrt(np.maximum(v[todo], 0))
    return grid, slope * grid + b + mean, sd


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, bandwidth: float = 0.75, robust: int = 2) -> np.ndarray:
    """Local linear regression with tricube weights and bisquare robustness."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    k = max(2, int(np.ceil(bandwidth * len(x))))
    weight = np.ones(len(x))

    def smooth(points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points))
        for i, p in enumerate(points):
            d = np.abs(x - p)
            h = np.partition(d, min(k, len(x)) - 1)[min(k, len(x)) - 1] or 1e-12
            w = weight * np.clip(1 - (d / h) ** 3, 0, None) ** 3
            s = w.sum()
            if s <= 0:
                out[i] = np.average(y)
                continue
            mx, my = (w @ x) / s, (w @ y) / s
            var = w @ (x - mx) ** 2
            out[i] = my + ((w @ ((x - mx) * (y - my))) / var * (p - mx) if var > 1e-12 else 0.0)
        return out

    for _ in range(robust):
        r = np.abs(y - smooth(x))
        mid = 6 * np.median(r)
        if mid <= 0:
            break
        weight = np.clip(1 - (r / mid) ** 2, 0, None) ** 2
    return smooth(at)


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    from math import exp, lgamma, log

    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def isotope_fit(expected: list[float], observed: list[float]) -> float:
    """Probability of a chi-square at least as large; degrees of freedom are peaks less one."""
    stat = sum(((e - o) / e) ** 2 for e, o in zip(expected, observed) if e)
    return upper_gamma((len(expected) - 1) / 2, stat / 2) if len(expected) > 1 else 1.0


def isotope_range(mass: float, k: int, spread: float = 0.12) -> tuple[float, float]:
    """Expected height of isotope k against the first, within 3.3 deviations: a Poisson model of an average peptide's heavy atoms."""
    from math import factorial

    heavy = mass * 0.000594
    ratio = heavy**k / factorial(k)
    return max(0.0, ratio * (1 - 3.3 * spread)), ratio * (1 + 3.3 * spread)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v**2).sum())
    return v / n if n else v


def dot_product(x: np.ndarray, y: np.ndarray) -> float:
    return float(unit(np.asarray(x, float)) @ unit(np.asarray(y, float)))


def contrast_angle(x: np.ndarray, y: np.ndarray) -> float:
    return 1 - 2 * float(np.arccos(min(1.0, dot_product(x, y)))) / np.pi


def binned(mz: np.ndarray, intensity: np.ndarray, width: float = 0.1) -> dict[int, float]:
    """Intensities split linearly between the two nearest bins; a bin keeps its greatest share."""
    out: dict[int, float] = {}
    for m, i in zip(mz, intensity):
        k = int(np.floor(m / width))
        part = m / width - k
        for b, v in ((k, i * (1 - part)), (k + 1, i * part)):
            if v > out.get(b, 0.0):
                out[b] = float(v)
    return out
