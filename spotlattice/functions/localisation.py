"""Scalar expressions over localisation rows: units, shape, signal, localisation precision, small solvers."""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the localisation-variance formula, kept at the published number of decimals.
SIXTEEN_NINTHS, EIGHT_PI = 1.7777777778, 25.13274123


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distance_factor(from_unit: str, to_unit: str, nm_per_pixel: float) -> float:
    """Multiplier between PIXEL, UM and NM."""
    nm = {"PIXEL": nm_per_pixel, "UM": 1000.0, "NM": 1.0}
    return nm[from_unit] / nm[to_unit]


def intensity_factor(from_unit: str, to_unit: str, count_per_photon: float) -> float:
    """Multiplier between COUNT and PHOTON."""
    counts = {"COUNT": 1.0, "PHOTON": count_per_photon}
    return counts[from_unit] / counts[to_unit]


def angle_factor(from_unit: str, to_unit: str) -> float:
    radians = {"RADIAN": 1.0, "DEGREE": math.pi / 180}
    return radians[from_unit] / radians[to_unit]


def time_factor(from_unit: str, to_unit: str, exposure_ms: float) -> float:
    ms = {"FRAME": exposure_ms, "SECOND": 1000.0, "MILLISECOND": 1.0}
    return ms[from_unit] / ms[to_unit]


def snr(signal="mean_intensity", noise="noise") -> Column:
    """Signal over noise; 0 where the noise is 0."""
    return F.when(col(noise) == 0, 0.0).otherwise(col(signal) / col(noise))


def height(intensity="intensity", sx="sx", sy="sy") -> Column:
    """Amplitude of a Gaussian spot."""
    return col(intensity) / (2 * math.pi * col(sx) * col(sy))


def width(sx="sx", sy="sy") -> Column:
    """One standard deviation for both axes."""
    return F.sqrt(F.abs(col(sx) * col(sy)))


def distance2(x1, y1, x2, y2) -> Column:
    return (col(x1) - col(x2)) * (col(x1) - col(x2)) + (col(y1) - col(y2)) * (col(y1) - col(y2))


def lse_variance(a, s, n, b2, emccd: bool = False) -> Column:
    """Variance of a least-squares position: pixel a, width s, photons n, background variance b2; infinite without photons."""
    a, s, n, b2 = map(col, (a, s, n, b2))
    sa2 = s * s + a * a / 12
    value = (2 if emccd else 1) * (sa2 / n) * (SIXTEEN_NINTHS + EIGHT_PI * sa2 * b2 / (n * a * a))
    return F.when(n <= 0, F.lit(math.inf)).otherwise(value)


def mle_terms(n: int = 64) -> list[tuple[float, float]]:
    """(u, c): the integral of ln(t) / (1 + rho / t) over 0 to 1 is the sum of c / (u + rho).

    Gauss-Legendre nodes of x with u = x**4, which takes the logarithm's pole off the nodes.
    """
    t, w = np.polynomial.legendre.leggauss(n)
    x = (t + 1) / 2
    u = x**4
    return [(float(a), float(b)) for a, b in zip(u, w / 2 * 4 * x**3 * u * np.log(u), strict=True)]


def mle_variance(a, s, n, b2, emccd: bool = False) -> Column:
    """Variance of a maximum-likelihood position; where its information integral is not positive, that of least squares."""
    a, s, n, b2 = map(col, (a, s, n, b2))
    sa2 = s * s + a * a / 12
    rho = 2 * math.pi * sa2 * b2 / (n * a * a)
    i1 = F.when(rho == 0, 1.0).otherwise(-functools.reduce(operator.add, [F.lit(c) / (F.lit(u) + rho) for u, c in mle_terms()]))
    return F.when(n <= 0, F.lit(math.inf)).when(i1 > 0, (2 if emccd else 1) * (sa2 / n) / i1).otherwise(lse_variance(a, s, n, b2, emccd))


#: What a precision is taken from, the first that is there: a stored value, fitted deviations, local background, noise.
PRECISION_SOURCES = ("stored", "crlb", "local_background", "noise")


def noise_of_background(background, emccd: bool = False) -> Column:
    """Noise that a background of so many photons makes; an electron-multiplying gain doubles its variance."""
    return F.sqrt(F.greatest(F.lit(0.0), col(background)) * (2 if emccd else 1))


def background_variance(noise, emccd: bool = False) -> Column:
    """The background variance of the precision formulas from a measured noise, which holds the gain's own part already."""
    return col(noise) * col(noise) / (2 if emccd else 1)


def precision_by(source: str, a, s, n, noise="noise", background="background", stored="precision", sd=("sdx", "sdy"), emccd: bool = False) -> Column:
    """Precision (in the unit of a and s) from one source of PRECISION_SOURCES; null where its columns are null."""
    if source == "stored":
        return F.when(col(stored) > 0, col(stored))
    if source == "crlb":
        return F.sqrt((col(sd[0]) * col(sd[0]) + col(sd[1]) * col(sd[1])) / 2)
    if source == "local_background":
        return F.sqrt(lse_variance(a, s, n, F.greatest(F.lit(0.0), col(background)), emccd))
    if source == "noise":
        return F.sqrt(lse_variance(a, s, n, background_variance(noise, emccd), emccd))
    raise ValueError(f"unknown source of precision {source!r}")


def best_precision(sources: list[str], *args, **options) -> tuple[Column, Column]:
    """(precision, source) of the first source that has one for the row."""
    found = [(precision_by(x, *args, **options), x) for x in sources]
    return F.coalesce(*[p for p, _ in found]), F.coalesce(*[F.when(p.isNotNull(), F.lit(x)) for p, x in found])


def cdf2d(r) -> Column:
    """Share of a circular Gaussian within r standard deviations."""
    return 1 - F.exp(-col(r) * col(r) / 2)


def inverse_cdf2d(p) -> Column:
    return F.sqrt(-2 * F.log(1 - col(p)))


def mean_signal(intensity, sx, sy, radius: float) -> Column:
    """Mean signal within ``radius`` standard deviations: the share there over the ellipse's area."""
    return col(intensity) * (1 - math.exp(-radius * radius / 2)) / (math.pi * radius * radius * col(sx) * col(sy))


def mean_signal_of_share(intensity, sx, sy, share: float = 0.5) -> Column:
    """Mean signal within the ellipse that holds ``share`` of the signal."""
    return col(intensity) * share / (math.pi * -2 * math.log(1 - share) * col(sx) * col(sy))


def translated(x, y, dx: float, dy: float) -> tuple[Column, Column]:
    return col(x) + dx, col(y) + dy


def unmix2(o1, o2, c12: float, c21: float) -> tuple[Column, Column]:
    """Two channels free of crosstalk: c_ij is the share of channel j's density seen in channel i."""
    d1 = (col(o1) - c21 * col(o2)) / (1 - c12 * c21)
    return d1, col(o2) - c12 * d1


def unmix3(o, mix: list[list[float]]) -> list[Column]:
    """Three channels by the inverse of the mixing matrix; the input where that is singular."""
    m = np.array(mix, float)
    if abs(np.linalg.det(m)) < 1e-12:
        return [col(x) for x in o]
    return [sum((float(v) * col(x) for v, x in zip(row, o, strict=True)), F.lit(0.0)) for row in np.linalg.inv(m)]


def msd_correction(n: int) -> float:
    """Observed to actual mean squared displacement of n frames with finite exposure."""
    return n / (n - 1 / 3)


def resequence(frame, start: int, block: int, skip: int) -> Column:
    """Frame of a gapless sequence to that of acquisition in blocks with skipped frames between."""
    f = col(frame) - 1
    return (start + f + skip * F.floor(f / block)).cast("int")


def row_digest(*columns: str) -> Column:
    """SHA-256 of a row's values in the order given; nulls have a mark of their own."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
