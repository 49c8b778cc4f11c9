"""Fits on the driver over histograms and curves that Spark has aggregated; numpy only."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def least_squares(model: Callable[[np.ndarray], np.ndarray], start: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, steps: int = 200) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with numeric derivatives: parameters and residual sum of squares."""
    p, w, damp = np.array(start, float), 1.0 if weights is None else np.sqrt(weights), 1e-3
    cost = lambda q: ((w * (model(q) - y)) ** 2).sum()
    now = cost(p)
    for _ in range(steps):
        base = model(p)
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.column_stack([(model(p + h * (np.arange(len(p)) == k)) - base) / h[k] for k in range(len(p))])
        jac = jac * (w if np.isscalar(w) else w[:, None])
        grad, hess = jac.T @ (w * (base - y)), jac.T @ jac
        step = np.linalg.solve(hess + damp * np.diag(np.diag(hess) + 1e-12), -grad)
        new = cost(p + step)
        if np.isfinite(new) and new < now:
            small = now - new < 1e-12 * (now + 1e-300)
            p, now, damp = p + step, new, damp / 5
            if small:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return p, float(now)


def blinking(counts: dict[int, float], n_fit: int) -> dict[str, float]:
    """Molecules and blinking from counts of traces at each dark threshold: N (1 + b exp((1 - t) / t_off))."""
    t = np.array(sorted(counts)[:n_fit], float)
    y = np.array([counts[int(k)] for k in t], float)
    model = lambda q: q[0] * (1 + q[1] * np.exp((1 - t) / max(q[2], 1e-6)))
    p, rss = least_squares(model, np.array([max(y[-1], 1), max(y[0] / max(y[-1], 1) - 1, 0.1), max(len(t) / 4, 1)]), y)
    return {"molecules": p[0], "blinking_rate": 1 + p[1], "t_off": p[2], "rss": rss}


def jump_distances(squared: np.ndarray, most: int = 10, min_fraction: float = 0.1, min_ratio: float = 2.0, counts: np.ndarray | None = None) -> list[tuple[float, float]]:
    """(D in squared units per step, fraction) of an exponential mixture of squared jumps by maximum likelihood.

    Populations are added while twice the gain of log likelihood passes the 5 % point of chi-squared with 2 degrees, every
    fraction stays above its least, and neighbours differ by the ratio asked for.  With ``counts``, each value stands for so
    many jumps (the mean of a bin of a histogram of them all).
    """
    x = np.asarray(squared, float)
    c = np.ones(len(x)) if counts is None else np.asarray(counts, float)
    x, c = x[x > 0], c[x > 0]
    if not len(x):
        return []
    n_jumps, order = c.sum(), np.argsort(x)
    rank = (np.cumsum(c[order]) - c[order] / 2) / n_jumps
    mean = (c * x).sum() / n_jumps
    best, best_ll = [(mean / 4, 1.0)], -n_jumps * (1 + math.log(mean))
    for n in range(2, most + 1):
        means = np.interp((np.arange(n) + 0.5) / n, rank, x[order])
        share = np.full(n, 1 / n)
        for _ in range(500):  # expectation maximisation
            dens = share / means * np.exp(-x[:, None] / means)
            resp = dens / dens.sum(1, keepdims=True) * c[:, None]
            share, means = resp.sum(0) / n_jumps, np.maximum((resp * x[:, None]).sum(0) / np.maximum(resp.sum(0), 1e-12), 1e-12)
        ll = float((c * np.log((share / means * np.exp(-x[:, None] / means)).sum(1))).sum())
        by_mean = np.argsort(means)
        means, share = means[by_mean], share[by_mean]
        if 2 * (ll - best_ll) < 5.991 or share.min() < min_fraction or (means[1:] / means[:-1]).min() < min_ratio:
            break
        best, best_ll = [(m / 4, s) for m, s in zip(means, share, strict=True)], ll
    return best


def residence(histogram: dict[int, int], populations: int, resolution: float = 1.0) -> dict[str, list[float]]:
    """Rates and fractions of a mixture of geometric (binned exponential) times by expectation maximisation."""
    t = np.array(sorted(histogram), float)
    n = np.array([histogram[int(k)] for k in t], float)
    mean = max((t * n).sum() / n.sum(), 0.1)
    k = mean * np.geomspace(0.3, 3, populations) if populations > 1 else np.array([mean])
    share = np.full(populations, 1 / populations)
    for _ in range(2000):
        q = k / (1 + k)  # chance to last one more bin
        dens = share * (1 - q) * q ** t[:, None]
        resp = dens / dens.sum(1, keepdims=True) * n[:, None]
        share, k = resp.sum(0) / n.sum(), np.maximum((resp * t[:, None]).sum(0) / np.maximum(resp.sum(0), 1e-12), 1e-9)
    order = np.argsort(k)
    rate = np.log((1 + k) / k) / resolution
    return {"rates": rate[order].tolist(), "fractions": share[order].tolist()}


def residence_likelihood(histogram: dict[int, int], fit: dict[str, list[float]], resolution: float = 1.0) -> float:
    """The log likelihood of binned times under rates and fractions of ``residence``."""
    t = np.array(sorted(histogram), float)
    n = np.array([histogram[int(k)] for k in t], float)
    q = np.exp(-np.array(fit["rates"]) * resolution)
    return float((n * np.log((np.array(fit["fractions"]) * (1 - q) * q ** t[:, None]).sum(1))).sum())


def residence_choice(histogram: dict[int, int], most: int = 3, resolution: float = 1.0) -> dict:
    """The fit of 1 to ``most`` populations with the least Bayesian information criterion: rates, fractions, bic."""
    size, best = sum(histogram.values()), None
    for n in range(1, most + 1):
        fit = residence(histogram, n, resolution)
        bic = (2 * n - 1) * math.log(size) - 2 * residence_likelihood(histogram, fit, resolution)
        if best is None or bic < best["bic"]:
            best = fit | {"bic": bic}
    return best


def residence_bootstrap(histogram: dict[int, int], populations: int, repeats: int = 100, level: float = 0.95, resolution: float = 1.0, seed: int = 0) -> dict[str, list[tuple[float, float]]]:
    """Intervals of rates and fractions over fits to resampled histograms."""
    rng = np.random.default_rng(seed)
    t = sorted(histogram)
    n = np.array([histogram[k] for k in t])
    fits = []
    for _ in range(repeats):
        drawn = rng.multinomial(n.sum(), n / n.sum())
        fits.append(residence({k: int(c) for k, c in zip(t, drawn, strict=True) if c}, populations, resolution))
    ends = lambda name: [tuple(np.quantile([f[name][k] for f in fits], [(1 - level) / 2, (1 + level) / 2]).tolist()) for k in range(populations)]
    return {"rates": ends("rates"), "fractions": ends("fractions")}


def msd_line(lags: np.ndarray, msd: np.ndarray, through_zero: bool = False) -> tuple[float, float]:
    """D and the intercept of msd = 4 D t + c."""
    a = lags[:, None] if through_zero else np.column_stack([lags, np.ones(len(lags))])
    sol = np.linalg.lstsq(a, msd, rcond=None)[0]
    return sol[0] / 4, 0.0 if through_zero else float(sol[1])


def gaussian_mixture(x: np.ndarray, n: int, seed: int = 0, steps: int = 200) -> dict[str, np.ndarray]:
    """Expectation maximisation of a multivariate mixture with full covariances."""
    rng = np.random.default_rng(seed)
    mean = [x[rng.integers(len(x))]]
    while len(mean) < n:  # spread starts
        d = np.min([((x - m) ** 2).sum(1) for m in mean], 0)
        mean.append(x[rng.choice(len(x), p=d / d.sum())])
    mean, cov, share = np.array(mean), np.array([np.cov(x.T) + 1e-6 * np.eye(x.shape[1])] * n), np.full(n, 1 / n)
    for _ in range(steps):
        logs = np.stack([np.log(share[k]) - 0.5 * (np.linalg.slogdet(cov[k])[1] + np.einsum("ij,ij->i", (x - mean[k]) @ np.linalg.inv(cov[k]), x - mean[k])) for k in range(n)], 1)
        resp = np.exp(logs - logs.max(1, keepdims=True))
        resp /= resp.sum(1, keepdims=True)
        mass = resp.sum(0)
        share, mean = mass / len(x), resp.T @ x / mass[:, None]
        cov = np.array([(resp[:, k, None] * (x - mean[k])).T @ (x - mean[k]) / mass[k] + 1e-6 * np.eye(x.shape[1]) for k in range(n)])
    return {"share": share, "mean": mean, "cov": cov, "label": resp.argmax(1)}


def binomial_sizes(histogram: dict[int, int], most: int) -> tuple[int, float]:
    """n and p of a zero-truncated binomial of cluster sizes with the best likelihood."""
    sizes = np.array(sorted(histogram))
    count = np.array([histogram[int(s)] for s in sizes], float)
    best = (-math.inf, 1, 1.0)
    for n in range(int(sizes.max()), most + 1):
        for p in np.linspace(0.01, 0.99, 99):
            log = np.array([math.lgamma(n + 1) - math.lgamma(s + 1) - math.lgamma(n - s + 1) for s in sizes]) + sizes * math.log(p) + (n - sizes) * math.log(1 - p)
            ll = float((count * (log - math.log(1 - (1 - p) ** n))).sum())
            best = max(best, (ll, n, float(p)))
    return best[1], best[2]


def evolve(score: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, size: int = 40, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """Genetic search of a box: ``score`` takes a whole population, so that one Spark job can score it."""
    rng = np.random.default_rng(seed)
    people = rng.uniform(low, high, (size, len(low)))
    for _ in range(rounds):
        fit = score(people)
        best = people[np.argsort(-fit)][: size // 4]
        mum, dad = best[rng.integers(len(best), size=(2, size - len(best)))]
        mix = rng.random(mum.shape)
        young = np.clip(mix * mum + (1 - mix) * dad + rng.normal(0, 0.05, mum.shape) * (high - low), low, high)
        people = np.vstack([best, young])
    fit = score(people)
    return people[fit.argmax()], float(fit.max())
