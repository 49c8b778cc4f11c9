"""Camera models: what a photon becomes in a pixel, its likelihood, and the precision that light allows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

erf = np.vectorize(math.erf, otypes=[float])
log_factorial = np.vectorize(lambda v: math.lgamma(v + 1), otypes=[float])


def corrected(pixels: np.ndarray, bias: np.ndarray | float, gain: np.ndarray | float) -> np.ndarray:
    """Photons of raw counts: one bias and gain, or one for each pixel."""
    return (pixels - bias) / gain


def poisson(mu: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log-likelihood of x photons where mu are expected; counts below zero count as none."""
    x, mu = np.maximum(x, 0), np.maximum(mu, 1e-12)
    return x * np.log(mu) - mu - log_factorial(x)


def poisson_gaussian(mu: np.ndarray, x: np.ndarray, read_noise: np.ndarray | float) -> np.ndarray:
    """The same with read noise (photons), per pixel if need be: both sides are moved by its variance."""
    v = np.square(read_noise)
    return poisson(mu + v, x + v)


def bessel_i1_scaled(x: np.ndarray) -> np.ndarray:
    """I1(x) exp(-x): the mean of exp(x (cos t - 1)) cos t over a half turn, which even steps give to all digits."""
    t = (np.arange(512) + 0.5) * math.pi / 512
    x = np.asarray(x, float)[..., None]
    near = (np.exp(x * (np.cos(t) - 1)) * np.cos(t)).mean(-1)
    x = x[..., 0]
    far = (1 - 3 / (8 * np.maximum(x, 1)) - 15 / (128 * np.maximum(x, 1) ** 2)) / np.sqrt(2 * math.pi * np.maximum(x, 1))
    return np.where(x < 5000, near, far)


def multiplied(photons: float, gain: float, counts: np.ndarray) -> np.ndarray:
    """Log density of counts after electron multiplication (Poisson, then Gamma); at zero the chance of no photon."""
    c = np.maximum(np.asarray(counts, float), 1e-9)
    root = 2 * np.sqrt(c * photons / gain)
    some = 0.5 * np.log(photons / (c * gain)) - c / gain - photons + np.log(np.maximum(bessel_i1_scaled(root), 1e-300)) + root
    return np.where(np.asarray(counts) <= 0, -photons, some)


def fit_multiplied(counts: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """(photons, gain) of greatest likelihood for a histogram of counts, by moments and a narrowing search around them."""
    total = times.sum()
    mean = float((counts * times).sum() / total)
    variance = float((times * (counts - mean) ** 2).sum() / max(total - 1, 1))
    gain = max(variance / max(2 * mean, 1e-9), 1e-6)
    best, width = np.log([max(mean, 1e-9) / gain, gain]), 0.5
    score = lambda p: float((times * multiplied(math.exp(p[0]), math.exp(p[1]), counts)).sum())
    value = score(best)
    while width > 1e-4:
        tries = [best + width * np.array([i, j]) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        scores = [score(p) for p in tries]
        k = int(np.argmax(scores))
        if scores[k] > value:
            best, value = tries[k], scores[k]
        else:
            width /= 2
    return float(np.exp(best[0])), float(np.exp(best[1]))


def astigmatic_width(z: float, s0: float, focus: float, depth: float, a: float = 0.0, b: float = 0.0) -> float:
    u = (z - focus) / depth
    return s0 * math.sqrt(max(1 + u * u + a * u**3 + b * u**4, 1e-6))


#: Parameters of each point-spread function after background, intensity, x and y.
SHAPES = {"circular": ("s",), "elliptical": ("sx", "sy"), "rotated": ("sx", "sy", "angle"), "astigmatic": ("z",)}


def spot(kind: str, p: np.ndarray, ys: np.ndarray, xs: np.ndarray, z_model: dict | None = None) -> np.ndarray:
    """Expected light over the pixels (ys, xs), whose centres are whole numbers.  Light is integrated over a pixel but for
    "rotated", which takes its centre.  ``z_model`` gives width, focus offset and depth of an astigmatic lens."""
    back, light, x, y, *shape = p
    if kind == "rotated":
        sx, sy, angle = abs(shape[0]) + 1e-3, abs(shape[1]) + 1e-3, shape[2]
        dx, dy = xs[None, :] - x, ys[:, None] - y
        u, v = dx * math.cos(angle) + dy * math.sin(angle), dy * math.cos(angle) - dx * math.sin(angle)
        return back + light / (2 * math.pi * sx * sy) * np.exp(-(u * u) / (2 * sx * sx) - v * v / (2 * sy * sy))
    if kind == "astigmatic":
        m = {"s0": 1.2, "offset": 0.3, "depth": 0.4} | (z_model or {})
        sx, sy = (astigmatic_width(shape[0], m["s0"], side * m["offset"], m["depth"]) for side in (1, -1))
    else:
        sx, sy = abs(shape[0]) + 1e-3, abs(shape[-1]) + 1e-3
    part = lambda at, c, s: (erf((at + 0.5 - c) / (s * math.sqrt(2))) - erf((at - 0.5 - c) / (s * math.sqrt(2)))) / 2
    return back + light * np.outer(part(ys, y, sy), part(xs, x, sx))


def information(model: Callable[[np.ndarray], np.ndarray], p: np.ndarray, read_noise: float = 0.0) -> np.ndarray:
    """Fisher information of the parameters where each pixel counts photons with read noise; by central differences."""
    p = np.asarray(p, float)
    steps = 1e-4 * np.maximum(np.abs(p), 1e-2)
    slopes = np.array([(model(p + h * e) - model(p - h * e)).ravel() / (2 * h) for h, e in zip(steps, np.eye(len(p)), strict=True)])
    return (slopes / np.maximum(model(p).ravel() + read_noise**2, 1e-9)) @ slopes.T


def bounds(model: Callable[[np.ndarray], np.ndarray], p: np.ndarray, read_noise: float = 0.0) -> np.ndarray:
    """Least standard deviation any unbiased fit can reach (Cramer-Rao), one a parameter."""
    return np.sqrt(np.diag(np.linalg.pinv(information(model, p, read_noise))))
