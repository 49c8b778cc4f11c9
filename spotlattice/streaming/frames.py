"""Streams of localisations: event time is the epoch plus frame times exposure.  Each has the meaning of its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_time(df: DataFrame, exposure_ms: float, frame: str = "frame") -> DataFrame:
    return df.withColumn("t", F.timestamp_millis((F.col(frame) * exposure_ms).cast("long")))


def tumbling(df: DataFrame, window: str, late: str = "10 seconds") -> DataFrame:
    """Counts and summed intensity of blocks of frames; late rows within the watermark still count."""
    w = df.withWatermark("t", late).groupBy(F.window("t", window).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum("intensity").alias("signal")).select(F.col("w.start").alias("start"), "n", "signal")


def burst_sessions(df: DataFrame, gap: str, late: str = "10 seconds") -> DataFrame:
    """Bursts of an id as session windows: a gap without rows ends one."""
    w = df.withWatermark("t", late).groupBy("id", F.session_window("t", gap).alias("w"))
    return w.agg(F.count("*").alias("size")).select("id", F.col("w.start").alias("start"), "size")


def trace(df: DataFrame, distance: float, memory: int) -> DataFrame:
    """Stateful tracing within each region: (region, row_id, trace).  State is the live tails; a tail is dropped when its
    last frame is more than ``memory`` behind, so the state is bounded by what was seen in that time.
    Rows of a micro-batch are taken in frame order; a row behind its region's newest frame starts a trace of its own."""
    state = "ids array<long>, ends array<int>, xs array<double>, ys array<double>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        tails = list(zip(*held.get, strict=True)) if held.exists else []
        rows = pd.concat(list(batches)).sort_values(["frame", "row_id"])
        out = []
        for frame, now in rows.groupby("frame"):
            tails = [x for x in tails if x[1] >= frame - memory]
            pairs = sorted((((r.x - x[2]) ** 2 + (r.y - x[3]) ** 2, k, r.row_id, r) for r in now.itertuples() for k, x in enumerate(tails) if x[1] < frame), key=lambda p: p[:3])
            used, of = set(), {}
            for d2, k, row_id, r in pairs:
                if d2 <= distance * distance and k not in used and row_id not in of:
                    used.add(k)
                    of[row_id] = tails[k][0]
                    tails[k] = (tails[k][0], int(frame), float(r.x), float(r.y))
            for r in now.itertuples():
                if r.row_id not in of:
                    of[r.row_id] = r.row_id
                    tails.append((int(r.row_id), int(frame), float(r.x), float(r.y)))
                out.append((key[0], r.row_id, of[r.row_id]))
        held.update(tuple(map(list, zip(*tails, strict=True))) if tails else ([], [], [], []))
        yield pd.DataFrame(out, columns=["region", "row_id", "trace"])

    return df.groupBy("region").applyInPandasWithState(step, "region long, row_id long, trace long", state, "append", "NoTimeout")
