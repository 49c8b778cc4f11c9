"""Pixel operators: a frame is a row (frame, width, height, pixels) and one unit of work for ``mapInPandas``."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "frame int, width int, height int, pixels array<float>"


def block_mean(img: np.ndarray, n: int) -> np.ndarray:
    """Mean of the (2n+1)-sided square around each pixel, edges repeated; by running sums."""
    p = np.pad(img.astype(float), n, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * n + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2


def gaussian(img: np.ndarray, sigma: float) -> np.ndarray:
    n = max(1, math.ceil(3 * sigma))
    k = np.exp(-(np.arange(-n, n + 1) ** 2) / (2 * sigma * sigma))
    return convolve(img, np.outer(k, k) / k.sum() ** 2)


def convolve(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    h, w = kernel.shape
    p = np.pad(img.astype(float), ((h // 2, h // 2), (w // 2, w // 2)), mode="edge")
    return np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(p, kernel.shape), kernel)


def circular_mean(img: np.ndarray, radius: float) -> np.ndarray:
    n = math.ceil(radius)
    y, x = np.mgrid[-n : n + 1, -n : n + 1]
    disc = (x * x + y * y <= radius * radius).astype(float)
    return convolve(img, disc / disc.sum())


def median(img: np.ndarray, n: int) -> np.ndarray:
    p = np.pad(img.astype(float), n, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (2 * n + 1, 2 * n + 1)), axis=(2, 3))


SMOOTHERS: dict[str, Callable] = {"block": block_mean, "gaussian": gaussian, "circular": circular_mean, "median": median}


def noise(img: np.ndarray, method: str = "residuals") -> float:
    """Standard deviation of a frame's noise: of all pixels, by median deviation, or of second differences."""
    if method == "all":
        return float(img.std())
    if method == "mad":
        return float(1.4826 * np.median(np.abs(img - np.median(img))))
    r = (4 * img[1:-1, 1:-1] - img[:-2, 1:-1] - img[2:, 1:-1] - img[1:-1, :-2] - img[1:-1, 2:]) / math.sqrt(20)
    return float(1.4826 * np.median(np.abs(r - np.median(r))))


def maxima(img: np.ndarray, n: int) -> list[tuple[int, int, float]]:
    """(x, y, score) of pixels above all others within n; equal ones: the first."""
    p = np.pad(img, n, constant_values=-np.inf)
    top = np.lib.stride_tricks.sliding_window_view(p, (2 * n + 1, 2 * n + 1)).max(axis=(2, 3))
    out: list[tuple[int, int, float]] = []
    near = np.zeros(img.shape, bool)  # within n of an accepted pixel; rows come in order, so only those to come are marked
    for y, x in zip(*np.nonzero(img >= top), strict=True):
        if not near[y, x]:
            near[y : y + n + 1, max(0, x - n) : x + n + 1] = True
            out.append((int(x), int(y), float(img[y, x])))
    return sorted(out, key=lambda s: -s[2])


def images(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for r in rows.itertuples(index=False):
        yield r.frame, np.asarray(r.pixels, float).reshape(r.height, r.width)


def per_frame(df: DataFrame, function: Callable[[int, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``function`` makes of each frame."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for rows in batches:
            yield pd.DataFrame([x for f, img in images(rows) for x in function(f, img)], columns=names)

    return df.mapInPandas(run, schema)


def smooth(df: DataFrame, kind: str, size: float) -> DataFrame:
    return per_frame(df, lambda f, img: [(f, img.shape[1], img.shape[0], SMOOTHERS[kind](img, size).ravel().astype(np.float32))], FRAME)


def find_spots(df: DataFrame, sigma: float = 1.0, wide: float = 0.0, border: int = 2) -> DataFrame:
    """Candidates of each frame: maxima of the smoothed image, or of the difference of two smoothings."""

    def spots(f: int, img: np.ndarray) -> list[tuple]:
        s = gaussian(img, sigma) - (gaussian(img, wide) if wide else 0.0)
        return [(f, x, y, v) for x, y, v in maxima(s, border)]

    return per_frame(df, spots, "frame int, x int, y int, score double")


def fit_gaussian(img: np.ndarray, x: int, y: int, n: int = 4, s0: float = 1.2) -> tuple[float, ...] | None:
    """background, intensity, x, y, s of a circular Gaussian around a candidate; None where the fit leaves the window."""
    from ..functions.fits import least_squares

    y0, y1, x0, x1 = max(0, y - n), min(img.shape[0], y + n + 1), max(0, x - n), min(img.shape[1], x + n + 1)
    part = img[y0:y1, x0:x1]
    yy, xx = np.mgrid[y0:y1, x0:x1]

    def model(p: np.ndarray) -> np.ndarray:
        s2 = max(p[4] ** 2, 1e-3)
        return (p[0] + p[1] / (2 * math.pi * s2) * np.exp(-((xx - p[2]) ** 2 + (yy - p[3]) ** 2) / (2 * s2))).ravel()

    low = float(np.percentile(part, 20))
    p, _ = least_squares(model, np.array([low, max((part - low).sum(), 1.0), x, y, s0]), part.ravel(), steps=60)
    good = x0 <= p[2] <= x1 and y0 <= p[3] <= y1 and p[1] > 0 and 0.3 < abs(p[4]) < 2 * n
    return (p[0], p[1], p[2], p[3], abs(p[4])) if good else None


def fit_psf(img: np.ndarray, x: int, y: int, kind: str = "circular", n: int = 5, s0: float = 1.2, likelihood: bool = True, read_noise: float = 0.0) -> tuple[np.ndarray, np.ndarray] | None:
    """(parameters, their least deviations) of a point-spread function around a candidate; None if it leaves the window.

    With ``likelihood`` the squares are weighted by the expected light and fitted again, which ends in the Poisson optimum.
    """
    from ..functions import camera
    from ..functions.fits import least_squares

    ys, xs = (np.arange(max(0, c - n), min(size, c + n + 1)) for c, size in ((y, img.shape[0]), (x, img.shape[1])))
    part = img[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    low = float(np.percentile(part, 20))
    shape = {"circular": [s0], "elliptical": [s0, s0], "rotated": [1.2 * s0, s0, 0.1], "astigmatic": [0.01]}[kind]
    model = lambda p: camera.spot(kind, p, ys, xs)
    flat = lambda p: model(p).ravel()
    p, _ = least_squares(flat, np.array([low, max((part - low).sum(), 1.0), x, y, *shape]), part.ravel(), steps=60)
    for _ in range(4 if likelihood else 0):
        p, _ = least_squares(flat, p, part.ravel(), 1 / np.maximum(flat(p) + read_noise**2, 0.1), steps=20)
    if not (xs[0] <= p[2] <= xs[-1] and ys[0] <= p[3] <= ys[-1] and p[1] > 0):
        return None
    return p, camera.bounds(model, p, read_noise)


def fit_shapes(df: DataFrame, kind: str = "elliptical", sigma: float = 1.0, min_height: float = 4.0, bias: float = 0.0, gain: float = 1.0, read_noise: float = 0.0) -> DataFrame:
    """Every candidate above ``min_height`` noises fitted by a point-spread function, on photons of a camera's counts.

    (frame, background, intensity, x, y, shape, sd): shape holds the kind's own parameters, sd the least deviations.
    """
    from ..functions.camera import corrected

    def run(f: int, raw: np.ndarray) -> list[tuple]:
        img = corrected(raw, bias, gain)
        level, smoothed = float(np.median(img)) + min_height * max(noise(img), 1e-9), gaussian(img, sigma)
        out = []
        for x, y, _ in maxima(smoothed, 2):
            found = fit_psf(img, x, y, kind, read_noise=read_noise) if img[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max() >= level else None
            if found:
                p, sd = found
                out.append((int(f), *map(float, p[:4]), [float(v) for v in p[4:]], [float(v) for v in sd]))
        return out

    return per_frame(df, run, "frame int, background double, intensity double, x double, y double, shape array<double>, sd array<double>")


def gain_of(pixels: DataFrame) -> DataFrame:
    """(gain, offset): the line of variance over mean of pixels, as ``mean_variance`` gives them."""
    return pixels.agg(F.regr_slope("variance", "mean").alias("gain"), F.regr_intercept("variance", "mean").alias("offset"))


def multiplied_gain(df: DataFrame, bias: float = 0.0) -> tuple[float, float]:
    """(photons, gain) of an electron-multiplying camera under even light; the driver gets one row a distinct count."""
    from ..functions.camera import fit_multiplied

    levels = df.select(F.explode("pixels").alias("v")).groupBy(F.round(F.col("v") - bias).alias("v")).agg(F.count("*").alias("n")).orderBy("v").toPandas()
    return fit_multiplied(levels["v"].to_numpy(float), levels["n"].to_numpy(float))


def fit_frames(df: DataFrame, sigma: float = 1.0, failures: int = 3, min_snr: float = 3.0) -> DataFrame:
    """Candidates in rank order, each fitted and validated; a frame ends after too many failures in a row."""

    def run(f: int, img: np.ndarray) -> list[tuple]:
        sd, out, fails = max(noise(img), 1e-9), [], 0
        smoothed = gaussian(img, sigma)
        for x, y, _ in maxima(smoothed, 2):
            p = fit_gaussian(img, x, y)
            if p is not None and p[1] / (2 * math.pi * p[4] ** 2) / sd >= min_snr and all((p[2] - o[3]) ** 2 + (p[3] - o[4]) ** 2 > 1 for o in out):
                out.append((f, *p, sd))
                fails = 0
            else:
                fails += 1
                if fails > failures:
                    break
        return out

    return per_frame(df, lambda f, img: [tuple(map(float, r[1:])) and (int(r[0]), *map(float, r[1:])) for r in run(f, img)], "frame int, background double, intensity double, x double, y double, s double, noise double")


def simulate(spark: SparkSession, frames: int, size: int = 32, spots: int = 3, photons: float = 800.0, background: float = 5.0, s: float = 1.3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(frames, truth): Poisson images of fixed-width spots; a frame's random numbers depend on (seed, frame) alone."""

    def truth_of(f: int) -> np.ndarray:
        return np.random.default_rng([seed, f]).uniform(5, size - 5, (spots, 2))

    def draw(batches):
        yy, xx = np.mgrid[:size, :size]
        for rows in batches:
            out = []
            for f in rows["id"]:
                img = np.full((size, size), background)
                for x, y in truth_of(int(f)):
                    img += photons / (2 * math.pi * s * s) * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * s * s))
                out.append((int(f), size, size, np.random.default_rng([seed, int(f), 1]).poisson(img).astype(np.float32).ravel()))
            yield pd.DataFrame(out, columns=["frame", "width", "height", "pixels"])

    def tell(batches):
        for rows in batches:
            yield pd.DataFrame([(int(f), float(x), float(y)) for f in rows["id"] for x, y in truth_of(int(f))], columns=["frame", "x", "y"])

    base = spark.range(1, frames + 1)
    return base.mapInPandas(draw, FRAME), base.mapInPandas(tell, "frame int, x double, y double")


def aggregate_frames(df: DataFrame, n: int) -> DataFrame:
    """Pixel sums of n frames each; by pixel, so that no frame is gathered with others."""
    pixels = df.select(F.floor((F.col("frame") - 1) / n).alias("block"), "width", "height", F.posexplode("pixels").alias("k", "v"))
    sums = pixels.groupBy("block", "width", "height", "k").agg(F.sum("v").alias("v"))
    return sums.groupBy("block", "width", "height").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"].cast("float")).alias("pixels")).select((F.col("block") + 1).cast("int").alias("frame"), "width", "height", "pixels")


def mean_variance(df: DataFrame) -> DataFrame:
    """Per pixel mean and variance over frames, for gain calibration."""
    return df.select(F.posexplode("pixels").alias("pixel", "v")).groupBy("pixel").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"))


def ring_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fourier ring correlation of two square images with tapered edges, by whole radius."""
    n = len(a)
    taper = np.outer(*[np.minimum(1, np.minimum(np.arange(n), np.arange(n)[::-1]) / max(1, n // 8))] * 2)
    fa, fb = (np.fft.fftshift(np.fft.fft2(x * taper)) for x in (a, b))
    y, x = np.indices(a.shape) - n // 2
    ring = np.hypot(x, y).astype(int).ravel()
    total = lambda v: np.bincount(ring, v.ravel())[: n // 2]
    return total((fa * fb.conj()).real) / np.maximum(np.sqrt(total(np.abs(fa) ** 2) * total(np.abs(fb) ** 2)), 1e-300)


def threshold_curve(method: str, n: int) -> np.ndarray:
    """The correlation below which a ring holds no signal, by radius 0 to n - 1.

    "1/7"; "0.5-bit", "1-bit", "2-bit": where both halves together hold so much information a ring's sample; "1-sigma" to
    "4-sigma": so many deviations of noise.  A ring of radius r counts as 2 pi r samples.
    """
    if method == "1/7":
        return np.full(n, 1 / 7)
    value, _, kind = method.partition("-")
    samples = np.maximum(2 * math.pi * np.arange(n), 1.0)
    if kind == "sigma":
        return float(value) / np.sqrt(samples / 2)
    if kind != "bit":
        raise ValueError(f"unknown threshold {method!r}")
    snr = (2 ** float(value) - 1) / 2
    noise = 1 / np.sqrt(samples)
    out = (snr + (2 * math.sqrt(snr) + 1) * noise) / (snr + 1 + 2 * math.sqrt(snr) * noise)
    out[0] = 1.0
    return out


def crossing(frc: np.ndarray, method: str = "1/7") -> float:
    """The radius at which a curve first falls through the threshold, between rings by a straight line; infinite if never.

    Bit and sigma curves start near 1, so that a first crossing above 0.9 gives way to the next one.
    """
    level = threshold_curve(method, len(frc))
    gap = frc - level
    found = [k for k in range(1, len(frc)) if gap[k - 1] >= 0 > gap[k]]
    at = [k - 1 + gap[k - 1] / (gap[k - 1] - gap[k]) for k in found]
    if method != "1/7" and len(at) > 1 and frc[found[0] - 1] > 0.9:
        at = at[1:]
    return float(at[0]) if at else math.inf


def resolution(df: DataFrame, scale: float, size: int, threshold: str = "1/7") -> float:
    """FIRE: the length at which the smoothed ring correlation of two random halves falls through the threshold.

    The halves are rastered by Spark; the driver gets at most two images of ``size`` squared pixels.
    """
    from .aggregates import render

    halves = []
    for side in (0, 1):
        part = render(df.where(F.pmod(F.xxhash64("row_id"), F.lit(2)) == side), scale).where(f"px >= 0 AND py >= 0 AND px < {size} AND py < {size}").toPandas()
        img = np.zeros((size, size))
        img[part["py"], part["px"]] = part["value"]
        halves.append(img)
    smooth = np.convolve(np.pad(ring_correlation(*halves), 2, mode="edge"), np.ones(5) / 5, "valid")
    at = crossing(smooth, threshold)
    return math.inf if at in (0.0, math.inf) else size / at / scale
