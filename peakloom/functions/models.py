"""Small statistical models on score vectors: densities, mixtures, discriminants."""

from __future__ import annotations

import numpy as np


def quantiles(x: np.ndarray, q, counts: np.ndarray | None = None) -> np.ndarray:
    """np.quantile of values that stand for `counts` equal ones each."""
    if counts is None:
        return np.quantile(x, q)
    by = np.argsort(x)
    upto = np.cumsum(counts[by])
    place = np.asarray(q) * (upto[-1] - 1)
    value = lambda i: x[by][np.minimum(np.searchsorted(upto, i, "right"), len(x) - 1)]
    low, high = value(np.floor(place)), value(np.ceil(place))
    return low + (high - low) * (place - np.floor(place))


def moments(x: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Mean and deviation."""
    mean = np.average(x, weights=counts)
    return float(mean), float(np.sqrt(np.average((x - mean) ** 2, weights=counts)))


def bandwidth(x: np.ndarray, counts: np.ndarray | None = None) -> float:
    sd, (q1, q3) = moments(x, counts)[1], quantiles(x, [0.25, 0.75], counts)
    n = len(x) if counts is None else counts.sum()
    return max(1e-9, 0.99 * min(sd, (q3 - q1) / 1.34 if q3 > q1 else sd) / n**0.2)


def density(x: np.ndarray, grid: np.ndarray, weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """Gaussian kernel density on a grid."""
    h = bandwidth(x, counts)
    w = np.ones(len(x)) if weights is None else weights
    w = w if counts is None else w * counts
    w = w / max(w.sum(), 1e-300)
    return (w * np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2)).sum(1) / (h * np.sqrt(2 * np.pi))


def kmeans(x: np.ndarray, k: int, rounds: int = 30, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels in one dimension, from quantiles."""
    c = np.ones(len(x)) if counts is None else counts
    centre = quantiles(x, (np.arange(k) + 0.5) / k, counts)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        label = np.abs(x[:, None] - centre).argmin(1)
        new = np.array([np.average(x[label == j], weights=c[label == j]) if (label == j).any() else centre[j] for j in range(k)])
        if np.allclose(new, centre):
            break
        centre = new
    return centre, label


def gaussians(x: np.ndarray, k: int = 2, stop: float = 1e-4, rounds: int = 500, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of a mixture by expectation maximisation, started from k-means."""
    c = np.ones(len(x)) if counts is None else counts
    mean, label = kmeans(x, k, counts=counts)
    sd = np.array([moments(x[label == j], c[label == j])[1] if c[label == j].sum() > 1 else moments(x, c)[1] for j in range(k)]) + 1e-6
    weight, before = np.bincount(label, c, minlength=k) / c.sum(), -np.inf
    for _ in range(rounds):
        p = weight * np.exp(-0.5 * ((x[:, None] - mean) / sd) ** 2) / (sd * np.sqrt(2 * np.pi)) + 1e-300
        like = (c * np.log(p.sum(1))).sum()
        r = c[:, None] * p / p.sum(1, keepdims=True)
        n = r.sum(0) + 1e-12
        weight, mean = n / c.sum(), (r * x[:, None]).sum(0) / n
        sd = np.sqrt((r * (x[:, None] - mean) ** 2).sum(0) / n) + 1e-6
        if abs(like - before) <= stop * abs(like):
            break
        before = like
    return weight, mean, sd


def posterior_table(target: np.ndarray, decoy: np.ndarray, identified: np.ndarray | None = None, bins: int = 1000, rounds: int = 50, stop: float = 1e-5, counts: tuple = (None, None, None)) -> dict[str, np.ndarray]:
    """score, local_p, global_p on a grid: decoys' kernel density against a kernel density of the targets weighted by their probability of being correct.

    counts: for how many hits each score of targets, decoys and identified stands.
    """
    of_target, of_decoy, of_identified = counts
    low, high = min(target.min(), decoy.min()), max(target.max(), decoy.max())
    grid = np.linspace(low, high, bins)
    wrong = density(decoy, grid, counts=of_decoy)
    mean_decoy = moments(decoy, of_decoy)[0]
    mean, sd = moments(identified, of_identified) if identified is not None and len(identified) else (mean_decoy, 0.0)
    start = max(mean - 3 * sd, mean_decoy)
    share = np.average(target <= start, weights=of_target) / max(np.average(decoy <= start, weights=of_decoy), 1e-9)
    pi = float(np.clip(1 - share, 0.01, 0.99))
    _, mean, sd = gaussians(target, 2, counts=of_target)
    j = int(mean.argmax())
    right = np.exp(-0.5 * ((grid - mean[j]) / sd[j]) ** 2) / (sd[j] * np.sqrt(2 * np.pi))
    before = -np.inf
    for _ in range(rounds):
        f1, f0 = pi * np.interp(target, grid, right), (1 - pi) * np.interp(target, grid, wrong)
        p = f1 / (f1 + f0 + 1e-300)
        like = float(np.dot(np.log(f1 + f0 + 1e-300), np.ones(len(target)) if of_target is None else of_target))
        pi = float(np.clip(np.average(p, weights=of_target), 1e-3, 1 - 1e-3))
        right = density(target, grid, p, of_target)
        if abs(like - before) <= stop * abs(like):
            break
        before = like
    c, d = pi * right, (1 - pi) * wrong
    up = lambda v: np.cumsum(v[::-1])[::-1]
    local = 0.999999 * c / (c + d + 1e-300)
    return {"score": grid, "local_p": np.maximum.accumulate(local), "global_p": 0.999999 * up(c) / (up(c) + up(d) + 1e-300)}


def discriminant(right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """Fisher's weights between two classes of sub-scores."""
    within = np.cov(right.T) * (len(right) - 1) + np.cov(wrong.T) * (len(wrong) - 1)
    within = np.atleast_2d(within) / max(1, len(right) + len(wrong) - 2) + 1e-6 * np.eye(right.shape[1])
    return np.linalg.solve(within, right.mean(0) - wrong.mean(0))


def iterated_discriminant(identified: np.ndarray, decoys: np.ndarray, seed: int = 7, alike: float = 0.95, rounds: int = 50, least: int = 5) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and the half of the decoys kept for modelling; trains on random halves until the weights hold still. None if a class is too small."""
    if min(len(identified), len(decoys)) < 2 * least:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(decoys))
    modelling, training = decoys[order[: len(decoys) // 2]], decoys[order[len(decoys) // 2 :]]
    weights = None
    for _ in range(rounds):
        n = min(max(least, len(identified) // 2), len(training))
        a = identified[rng.permutation(len(identified))[:n]]
        b = training[rng.permutation(len(training))[:n]]
        new = discriminant(a, b)
        if weights is not None:
            r = np.corrcoef(weights, new)[0, 1] if len(new) > 1 else 1.0
            weights = (weights + new) / 2
            if r * r >= alike:
                break
        else:
            weights = new
    return weights, modelling
