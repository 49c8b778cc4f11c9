"""Drift of the sample from the rows themselves: fixed markers, or blocks of frames aligned to the whole image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shared_table


def loess(t: np.ndarray, v: np.ndarray, w: np.ndarray, span: float, robust: int = 1) -> np.ndarray:
    """Local weighted lines over the nearest share ``span`` of points, tricube in distance, bisquare in residuals."""
    k = max(2, int(np.ceil(span * len(t))))
    if len(t) <= 2 or span <= 0:
        return v.copy()
    trust, out = np.ones(len(t)), v.copy()
    for _ in range(robust + 1):
        for i in range(len(t)):
            low = int(np.clip(i - k // 2, 0, max(0, len(t) - k)))
            part = slice(low, low + k)
            far = np.abs(t[part] - t[i])
            h = max(far.max(), 1e-12)
            g = w[part] * trust[part] * (1 - np.minimum(far / h, 1) ** 3) ** 3 + 1e-12
            mt, mv = np.average(t[part], weights=g), np.average(v[part], weights=g)
            var = np.average((t[part] - mt) ** 2, weights=g)
            slope = np.average((t[part] - mt) * (v[part] - mv), weights=g) / var if var > 0 else 0.0
            out[i] = mv + slope * (t[i] - mt)
        r = np.abs(v - out)
        m = 6 * np.median(r)
        trust = np.where(r < m, (1 - (r / max(m, 1e-300)) ** 2) ** 2, 0.0) if m > 0 else np.ones(len(t))
    return out


def from_markers(df: DataFrame, span: float = 0.3, tolerance: float = 1e-3, most: int = 50) -> DataFrame:
    """(frame, dx, dy) to add to positions, from rows (marker, frame, x, y, intensity) of objects that do not move.

    Rows are summed to one per marker and frame first.  Each pass moves every frame by the signal-weighted mean of what its
    markers lack to their centres, smooths over frames, and takes out the mean.  The driver holds one row a frame, never
    rows.  Frames between known ones are interpolated; without rows the result is empty.
    """
    per = shared_table(df.where("intensity > 0").groupBy("marker", "frame").agg(F.sum("intensity").alias("w"), F.sum(F.col("x") * F.col("intensity")).alias("sx"), F.sum(F.col("y") * F.col("intensity")).alias("sy")))
    spark, schema = df.sparkSession, "frame int, dx double, dy double"
    base = per.groupBy("frame").agg(F.sum("w").alias("w")).orderBy("frame").toPandas()
    if base.empty:
        return spark.createDataFrame([], schema)
    t, w = base["frame"].to_numpy(float), base["w"].to_numpy(float)
    now = np.zeros((len(t), 2))
    for _ in range(most):
        moves = spark.createDataFrame(pd.DataFrame({"frame": base["frame"].astype(int), "dx": now[:, 0], "dy": now[:, 1]}), schema)
        moved = per.join(moves, "frame").select("marker", "frame", "w", (F.col("sx") + F.col("w") * F.col("dx")).alias("mx"), (F.col("sy") + F.col("w") * F.col("dy")).alias("my"))
        centres = moved.groupBy("marker").agg((F.sum("mx") / F.sum("w")).alias("cx"), (F.sum("my") / F.sum("w")).alias("cy"))
        lack = moved.join(centres, "marker").groupBy("frame").agg((F.sum(F.col("w") * F.col("cx") - F.col("mx")) / F.sum("w")).alias("ux"), (F.sum(F.col("w") * F.col("cy") - F.col("my")) / F.sum("w")).alias("uy"))
        step = lack.orderBy("frame").toPandas()[["ux", "uy"]].to_numpy()
        new = np.column_stack([loess(t, (now + step)[:, k], w, span) for k in (0, 1)])
        new -= new.mean(0)
        change, now = np.hypot(*(new - now).T).sum(), new
        if change <= tolerance * len(t):
            break
    every = np.arange(int(t[0]), int(t[-1]) + 1)
    return spark.createDataFrame(pd.DataFrame({"frame": every, "dx": np.interp(every, t, now[:, 0]), "dy": np.interp(every, t, now[:, 1])}), schema)


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dx, dy) that moves image a onto image b: the peak of their correlation, to a part of a pixel by parabolas."""
    c = np.fft.ifft2(np.fft.fft2(b) * np.fft.fft2(a).conj()).real
    y, x = np.unravel_index(int(c.argmax()), c.shape)

    def peak(low: float, mid: float, high: float) -> float:
        bend = low - 2 * mid + high
        return 0.0 if bend == 0 else float(np.clip((low - high) / (2 * bend), -0.5, 0.5))

    h, w = c.shape
    fy = y + peak(c[y - 1, x], c[y, x], c[(y + 1) % h, x])
    fx = x + peak(c[y, x - 1], c[y, x], c[y, (x + 1) % w])
    return float(fx - w if fx > w / 2 else fx), float(fy - h if fy > h / 2 else fy)


def finite(name: str) -> Column:
    return F.abs(F.col(name)) < float("inf")  # NaN is above all numbers


def extent(raster: DataFrame) -> tuple[int, int, int, int]:
    """The lowest px and py, and the width and height in pixels from there that hold them all; 0 without pixels."""
    x0, x1, y0, y1 = raster.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    return (0, 0, 0, 0) if x0 is None else (x0, y0, x1 - x0 + 1, y1 - y0 + 1)


def from_images(df: DataFrame, frames: int, scale: float, size: int, most: int = 1024) -> DataFrame:
    """(block, frame, dx, dy): each block of frames aligned to the image of all rows; frame is the block's middle.

    Blocks are rastered by Spark and one block's image is one group; the reference image, as large, is sent to the tasks.
    Images cover the bounds of all rows, with ``size`` pixels a side at least.  Where that takes more than ``most`` a side,
    pixels are whole times larger instead, so no row falls outside; only rows without a finite position do not count.
    """
    pixel = lambda c: F.floor(F.col(c) * scale)
    raster = df.where(finite("x") & finite("y")).select(F.floor(F.col("frame") / frames).cast("int").alias("block"), pixel("x").alias("px"), pixel("y").alias("py"), "intensity")
    raster = shared_table(raster.groupBy("block", "px", "py").agg(F.sum("intensity").alias("v")))
    x0, y0, width, height = extent(raster)
    side = max(width, height)
    fold = max(1, -(-side // most))
    size, scale = max(size, -(-side // fold)), scale / fold
    cell = lambda c, low: F.floor((F.col(c) - low) / fold).cast("int").alias(c)
    raster = raster.groupBy("block", cell("px", x0), cell("py", y0)).agg(F.sum("v").alias("v"))
    whole = raster.groupBy("px", "py").agg(F.sum("v").alias("v")).toPandas()
    reference = np.zeros((size, size))
    reference[whole["py"], whole["px"]] = whole["v"]

    def align(rows: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((size, size))
        img[rows["py"], rows["px"]] = rows["v"]
        dx, dy = shift_between(img, reference)
        block = int(rows["block"].iloc[0])
        return pd.DataFrame({"block": [block], "frame": [block * frames + frames // 2], "dx": [dx / scale], "dy": [dy / scale]})

    return raster.groupBy("block").applyInPandas(align, "block int, frame int, dx double, dy double")


def frequency_correlation(df: DataFrame, scale: float, size: int | None, reach: int, window: bool = True, most: int = 2048) -> DataFrame:
    """(radius, g, se, n): pair correlation of the image of all rows by Fourier transform, by whole pixel radius from 1.

    The raster is made by Spark; it covers the bounds of all rows, with ``size`` pixels a side at least, if that is given.  The
    driver gets its pixels; bounds of more than ``most`` a side are refused, never cut.  The image is padded by ``reach``,
    tapered if ``window`` is set, and divided by the autocorrelation of its own weights; lags without weight do not count.
    """
    from .aggregates import render

    raster, schema = shared_table(render(df.where(finite("x") & finite("y")).withColumn("intensity", F.lit(1.0)), scale)), "radius int, g double, se double, n int"
    x0, y0, width, height = extent(raster)
    if max(width, height) > most:
        raise ValueError(f"an image of {width} by {height} pixels exceeds {most} a side: the scale must be less")
    shape = max(height, size or 0), max(width, size or 0)
    if not all(shape):
        return df.sparkSession.createDataFrame([], schema)
    part, img = raster.toPandas(), np.zeros(shape)
    img[part["py"] - y0, part["px"] - x0] = part["value"]
    edges = [np.arange(n) for n in shape]
    weight = np.outer(*[np.minimum(1.0, (np.minimum(e, e[::-1]) + 1) / max(1, len(e) // 8)) if window else np.ones(len(e)) for e in edges])
    padded = [n + reach for n in shape]
    auto = lambda v: np.fft.fftshift(np.fft.ifft2(np.abs(np.fft.fft2(v, padded)) ** 2).real)
    density, overlap = (img * weight).sum() / weight.sum(), auto(weight)
    g = auto(img * weight) / np.maximum(overlap, 1e-9) / max(density, 1e-300) ** 2
    y, x = (k - n // 2 for k, n in zip(np.indices(g.shape), padded, strict=True))
    r = np.where(overlap > 1e-6, np.rint(np.hypot(x, y)).astype(int), -1)
    out = [(k, float(v.mean()), float(v.std(ddof=1) / np.sqrt(len(v))), len(v)) for k in range(1, reach + 1) for v in [g[r == k]] if len(v) > 1]
    return df.sparkSession.createDataFrame(out, schema)
