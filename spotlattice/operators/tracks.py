"""Windows over tracks: jumps, blinks, islands, bursts, activations, displacement by lag.  A track is the rows of one id.

Rows of one track are ordered by (frame, row_id).  Every function is one shuffle by track; several of them over the same
frame share it, since the partitioning is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.localisation import distance2, msd_correction

def by_track():
    return Window.partitionBy("id").orderBy("frame", "row_id")


def with_jumps(df: DataFrame) -> DataFrame:
    """Adds gap (frames) and jump2 (squared distance) to the row before; null for a track's first row."""
    px, py, pf = (F.lag(c).over(by_track()) for c in ("x", "y", "frame"))
    return df.withColumns({"gap": F.col("frame") - pf, "jump2": distance2("x", "y", px, py)})


def adjacent_msd(df: DataFrame) -> DataFrame:
    """Mean squared and mean distance between neighbours of a track, with its size."""
    return with_jumps(df).groupBy("id").agg(F.count("*").alias("n"), F.avg("jump2").alias("msd"), F.avg(F.sqrt("jump2")).alias("mean_distance"))


def track_diffusion(df: DataFrame, error: float, n_correction: int = 2) -> DataFrame:
    """Track length in frames and D: jumps less the localisation error, corrected for exposure, over gaps, by four."""
    jump = F.greatest(F.lit(0.0), F.col("jump2") - 4 * error * error) * msd_correction(n_correction)
    out = with_jumps(df).groupBy("id").agg((F.max("frame") - F.min("frame")).alias("length"), F.sum(jump).alias("_j"), F.sum("gap").alias("_g"))
    return out.select("id", "length", F.when(F.col("_g") > 0, F.col("_j") / F.col("_g") / 4).alias("d"))


def islands(df: DataFrame, max_gap: int = 1, max_jump: float | None = None, name: str = "part") -> DataFrame:
    """Numbers the parts of each track (from 0): a part ends before a gap, or a jump, above the limit."""
    new = F.col("gap") > max_gap
    if max_jump is not None:
        new = new | (F.col("jump2") > max_jump * max_jump)
    return with_jumps(df).withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(by_track()).cast("int")).drop("gap", "jump2")


def split_long(df: DataFrame, most: int, name: str = "part") -> DataFrame:
    """Numbers runs of ``most`` rows within each track."""
    return df.withColumn(name, F.floor((F.row_number().over(by_track()) - 1) / most).cast("int"))


def blinks(df: DataFrame) -> DataFrame:
    """Per track: on-runs (blinks), total on and off time; an off time is the gap less one."""
    return with_jumps(df).groupBy("id").agg(
        (1 + F.sum(F.when(F.col("gap") > 1, 1).otherwise(0))).alias("n_blinks"),
        F.countDistinct("frame").alias("t_on"),
        F.sum(F.when(F.col("gap") > 1, F.col("gap") - 1).otherwise(0)).alias("t_off"),
    )


def off_times(df: DataFrame) -> DataFrame:
    return with_jumps(df).where("gap > 1").select("id", (F.col("gap") - 1).alias("t_off"))


def dark_time_cdf(df: DataFrame) -> DataFrame:
    """Off times, their counts, and the percentage of times up to each.  The window runs over the distinct times only."""
    counts = off_times(df).groupBy("t_off").agg(F.count("*").alias("n"))
    w = Window.orderBy("t_off")
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select("t_off", "n", (100 * F.sum("n").over(w) / total).alias("percent"))


def dark_time_percentile(df: DataFrame, percent: float) -> DataFrame:
    """(t_off, percent): the first off time at which so many percent of the off times are reached."""
    return dark_time_cdf(df).where(F.col("percent") >= percent).agg(F.min_by(F.struct("t_off", "percent"), "t_off").alias("_s")).where("_s is not null").select("_s.*")


def jump_histogram(df: DataFrame, lags: list[int], width: float) -> DataFrame:
    """(lag, bin, n): jumps of tracks over each frame lag, binned by distance; rows of a track in the same frame do not jump."""
    w = Window.partitionBy("id").orderBy("frame")
    out = df
    for k, lag in enumerate(lags):
        x, y = (F.first(c, ignorenulls=True).over(w.rangeBetween(lag, lag)) for c in ("x", "y"))
        out = out.withColumn(f"_j{k}", F.sqrt(distance2(x, y, "x", "y")))
    jumps = out.select(F.inline(F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"_j{k}").alias("j")) for k, lag in enumerate(lags)])))
    return jumps.where("j is not null").groupBy("lag", F.floor(F.col("j") / width).alias("bin")).agg(F.count("*").alias("n"))


def bursts(df: DataFrame, dark_tolerance: int, min_size: int) -> DataFrame:
    """Activation bursts per id: counts by frame, a new burst where the gap exceeds the tolerance by more than one."""
    by_frame = df.groupBy("id", "frame").agg(F.count("*").alias("c"))
    w = Window.partitionBy("id").orderBy("frame")
    new = F.when(F.col("frame") - F.lag("frame").over(w) > dark_tolerance + 1, 1).otherwise(0)
    out = by_frame.withColumn("_new", new).withColumn("burst", F.sum("_new").over(w).cast("int")).groupBy("id", "burst")
    return out.agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.sum("c").alias("size")).where(F.col("size") >= min_size)


def burst_clusters(df: DataFrame, dark_tolerance: int, min_size: int) -> DataFrame:
    """The same bursts with duration, bounding area and density of their rows; density is null where there is no area."""
    w = Window.partitionBy("id").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(w)
    out = df.withColumn("_new", F.when(gap > dark_tolerance + 1, 1).otherwise(0)).withColumn("burst", F.sum("_new").over(w).cast("int")).groupBy("id", "burst")
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    sums = out.agg(F.count("*").alias("size"), (F.max("frame") - F.min("frame") + 1).alias("duration"), area.alias("area"))
    return sums.where(F.col("size") >= min_size).withColumn("density", F.when(F.col("area") > 0, F.col("size") / F.col("area")))


def activations(df: DataFrame, dark_frames: int, repeat: int, starts: list[int]) -> DataFrame:
    """Numbers activations by the gap to the end of the row before; the channel is the start that frame mod repeat meets."""
    new = F.when(F.col("frame") >= F.lag("end_frame").over(by_track()) + dark_frames + 1, 1).otherwise(0)
    channel = F.coalesce(*[F.when(F.col("frame") % repeat == s, k + 1) for k, s in enumerate(starts)], F.lit(0))
    return df.withColumn("_new", new).withColumn("activation", F.sum("_new").over(by_track()).cast("int")).withColumn("channel", channel).drop("_new")


def msd_by_lag(df: DataFrame, max_lag: int, from_origin: bool = False) -> DataFrame:
    """Mean squared displacement per track and index lag: of all pairs a lag apart, or from the first row only.

    ``lead`` by each lag on one sorted window replaces the self-join: rows grow with max_lag, not with track length.
    """
    lags = []
    for k in range(1, max_lag + 1):
        x, y = (F.lead(c, k).over(by_track()) for c in ("x", "y"))
        lags.append(F.struct(F.lit(k).alias("lag"), distance2(x, y, "x", "y").alias("d2")))
    rows = df.select("id", F.row_number().over(by_track()).alias("_k"), F.array(*lags).alias("_all")).select("id", "_k", F.explode("_all").alias("_l"))
    if from_origin:
        rows = rows.where("_k = 1")
    return rows.where("_l.d2 is not null").groupBy("id", "_l.lag").agg(F.avg("_l.d2").alias("msd"), F.count("*").alias("n"))


def sliding_features(df: DataFrame, size: int) -> DataFrame:
    """Windows of ``size`` rows of each contiguous part: mean step, net drift, straightness, diffusion (mean squared step
    over four); named by the middle row, whose category they have where there is one."""
    parts = islands(df)
    w = Window.partitionBy("id", "part").orderBy("frame", "row_id")
    ahead = w.rowsBetween(0, size - 1)
    step = F.sqrt(distance2("x", "y", F.lag("x").over(w), F.lag("y").over(w)))
    rows = parts.withColumn("_s", step)
    kept = ["category"] if "category" in df.columns else []
    middle = {"category": F.lead("category", size // 2).over(w)} if kept else {}
    out = rows.withColumns({
        **middle, "d": F.avg(F.col("_s") * F.col("_s")).over(w.rowsBetween(1, size - 1)) / 4,
        "_n": F.count("*").over(ahead), "mean_step": F.avg("_s").over(w.rowsBetween(1, size - 1)),
        "drift": F.sqrt(distance2("x", "y", F.last("x").over(ahead), F.last("y").over(ahead))), "middle": F.lead("row_id", size // 2).over(w),
    })
    ratio = F.when(F.col("mean_step") > 0, F.col("drift") / (F.col("mean_step") * (size - 1)))
    return out.where(F.col("_n") == size).select("id", "part", F.col("middle").alias("row_id"), "mean_step", "drift", ratio.alias("straightness"), "d", *kept)


def residence_times(df: DataFrame, min_size: int, max_jump: float | None = None) -> DataFrame:
    """Histogram of (last - first frame - (min_size - 1)) of tracks without two rows in a frame or a too long jump."""
    rows = with_jumps(df).groupBy("id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count("*").alias("n"), F.min("gap").alias("g"), F.max("jump2").alias("j"))
    good = (F.col("n") >= min_size) & F.coalesce(F.col("g") > 0, F.lit(True))
    if max_jump is not None:
        good = good & F.coalesce(F.col("j") <= max_jump * max_jump, F.lit(True))
    return rows.where(good).groupBy((F.col("b") - F.col("a") - (min_size - 1)).alias("t")).agg(F.count("*").alias("n")).where("t >= 0")


def expand_frames(df: DataFrame) -> DataFrame:
    """One row for every frame that a row spans."""
    return df.withColumn("frame", F.explode(F.sequence("frame", "end_frame"))).withColumn("end_frame", F.col("frame"))


def temporal_median(df: DataFrame, radius: int) -> DataFrame:
    """Median of a pixel's values over a window of frames around each; one group is one pixel's time series."""

    def pixel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        v, f = rows["value"].to_numpy(float), rows["frame"].to_numpy()
        low, high = np.searchsorted(f, f - radius), np.searchsorted(f, f + radius, "right")
        rows["value"] = [float(np.median(v[a:b])) for a, b in zip(low, high, strict=True)]
        return rows

    return df.groupBy("ix", "iy").applyInPandas(pixel, df.schema)


def cumulative(df: DataFrame, value: str, width: float) -> DataFrame:
    """Histogram in uniform bins with the cumulative fraction."""
    bins = df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")
    return bins.select("bin", "n", (F.sum("n").over(w) / F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("fraction"))


def first_by(order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("frame").orderBy(order, "row_id"))
