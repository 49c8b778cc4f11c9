"""Predicates over localisation rows.  All bounds are inclusive; a limit of 0 or less is none."""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.localisation import height, snr, width


def at_least(x: Column, limit: float) -> Column:
    return F.lit(True) if limit <= 0 else x >= limit


def at_most(x: Column, limit: float) -> Column:
    return F.lit(True) if limit <= 0 else x <= limit


def signal(limit: float, gain: float = 1.0) -> Column:
    return at_least(F.col("intensity"), limit * gain)


def min_snr(limit: float) -> Column:
    return snr() >= limit


def anr(limit: float) -> Column:
    """Amplitude over noise; rows without noise pass."""
    return (F.col("noise") <= 0) | (height() / F.col("noise") >= limit)


def sbr(limit: float) -> Column:
    """Signal over root background; over noise where there is no background."""
    return F.when(F.col("background") > 0, F.col("mean_intensity") / F.sqrt("background")).otherwise(snr()) >= limit


def width_range(s0: float, low: float, high: float) -> Column:
    return at_least(width(), s0 * low) & at_most(width(), s0 * high)


def xy_width_range(s0x: float, s0y: float, low: float, high: float) -> Column:
    area = F.col("sx") * F.col("sy")
    return at_least(area, s0x * s0y * low * low) & at_most(area, s0x * s0y * high * high)


def shift(s0x: float, s0y: float, limit: float) -> Column:
    return at_most(F.abs("x"), s0x * limit) & at_most(F.abs("y"), s0y * limit)


def euclid_shift(s0x: float, s0y: float, limit: float) -> Column:
    return at_most(F.col("x") * F.col("x") + F.col("y") * F.col("y"), s0x * s0y * limit * limit)


def precision(variance: Column, limit: float) -> Column:
    return at_most(variance, limit * limit)


def precision_crlb(limit: float) -> Column:
    """Of the fitted deviations; rows without them pass."""
    return F.col("sdx").isNull() | F.col("sdy").isNull() | (F.col("sdx") * F.col("sdx") + F.col("sdy") * F.col("sdy") <= 2 * limit * limit)


def box(x0: float, x1: float, y0: float, y1: float) -> Column:
    return F.col("x").between(x0, x1) & F.col("y").between(y0, y1)


def depth(z0: float, z1: float) -> Column:
    return F.col("z").between(z0, z1)


def every(*conditions: Column) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def some(*conditions: Column) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


#: Names that a specification may use; each entry takes the arguments given beside it.
NAMED = {"signal": signal, "snr": min_snr, "anr": anr, "sbr": sbr, "width": width_range, "xy_width": xy_width_range, "shift": shift, "euclid_shift": euclid_shift, "crlb": precision_crlb, "box": box, "depth": depth}


def from_spec(spec: dict) -> Column:
    """A condition from nested dictionaries: {"and": [...]}, {"or": [...]}, {"not": ...} or {name: [arguments]}."""
    (name, value), *more = spec.items()
    if more:
        raise ValueError("one condition to a dictionary")
    if name in ("and", "or"):
        return (every if name == "and" else some)(*map(from_spec, value))
    if name == "not":
        return ~from_spec(value)
    return NAMED[name](*value)


def multi(snr_limit: float, s0: float, low: float, high: float, variance: Column, precision_limit: float, shift_limit: float, signal_limit: float) -> Column:
    """The usual conjunction; a smaller upper width than the lower one is swapped."""
    low, high = min(low, high), max(low, high)
    return every(min_snr(snr_limit), width_range(s0, low, high), precision(variance, precision_limit), shift(s0, s0, shift_limit), signal(signal_limit))


def crop(df: DataFrame, x0: float, y0: float, w: float, h: float, reset: bool = False) -> DataFrame:
    """Rows in a rectangle whose upper edges are open; ``reset`` moves its corner to the origin."""
    out = df.where((F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h))
    return out.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0}) if reset else out


def any_row(df: DataFrame, condition: Column) -> bool:
    """Whether a row meets the condition: a scan that stops at the first one."""
    return not df.where(condition).limit(1).isEmpty()


def whole_bounds(df: DataFrame) -> tuple[int, int, int, int]:
    """(x, y, width, height) in whole pixels that hold all rows; 1 wide at least."""
    r = df.agg(F.floor(F.min("x")).alias("a"), F.ceil(F.max("x")).alias("b"), F.floor(F.min("y")).alias("c"), F.ceil(F.max("y")).alias("d")).first()
    if r["a"] is None:
        return 0, 0, 0, 0
    return r["a"], r["c"], max(1, r["b"] - r["a"]), max(1, r["d"] - r["c"])


def crop_to(df: DataFrame, border: float = 0.0, box: tuple[float, float, float, float] | None = None, roi: tuple[tuple[float, float, float, float], tuple[float, float]] | None = None, z: tuple[float, float] | None = None, reset: bool = False) -> DataFrame:
    """Rows inside all of: the whole bounds less a border; a box (x, y, w, h); a region of an image (its rectangle, the image's
    size), scaled to the bounds; depths from z0 to z1.  ``reset`` moves the lower corner's whole pixel to the origin."""
    bx, by, bw, bh = whole_bounds(df)
    x0, y0, x1, y1 = bx + border, by + border, bx + bw - border, by + bh - border
    boxes = [box] if box else []
    if roi and bw and bh:
        (rx, ry, rw, rh), (iw, ih) = roi
        boxes.append((rx * bw / iw, ry * bh / ih, rw * bw / iw, rh * bh / ih))
    for bx, by, bw, bh in boxes:
        x0, y0, x1, y1 = max(x0, bx), max(y0, by), min(x1, bx + bw), min(y1, by + bh)
    out = crop(df, x0, y0, max(0.0, x1 - x0), max(0.0, y1 - y0))
    if z:
        out = out.where(depth(*z))
    return out.withColumns({"x": F.col("x") - math.floor(x0), "y": F.col("y") - math.floor(y0)}) if reset else out


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule, as one expression: the parity of the edges crossed to the right, behind the bounding box."""
    crossed = F.lit(0)
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1], strict=True):
        if ya != yb:
            over = (F.lit(ya) > y) != (F.lit(yb) > y)
            crossed = crossed + F.when(over & (x < (xb - xa) * (y - ya) / (yb - ya) + xa), 1).otherwise(0)
    xs, ys = zip(*corners, strict=True)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossed % 2 == 1)


def split_modes(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Kept and rejected rows; a null condition rejects."""
    sure = F.coalesce(keep, F.lit(False))
    return df.where(sure), df.where(~sure)


def by_mask(df: DataFrame, mask: DataFrame, how: str = "left") -> DataFrame:
    """Adds the label of the pixel a row falls in; 0 outside.  The mask is broadcast by AQE when it is small, else shuffled."""
    keyed = df.withColumns({"ix": F.col("x").cast("int"), "iy": F.col("y").cast("int")})
    return keyed.join(mask, ["ix", "iy"], how).withColumn("label", F.coalesce("label", F.lit(0)))


def apply_drift(df: DataFrame, drift: DataFrame) -> DataFrame:
    """x and y moved by the drift of the row's frame; frames without drift stay."""
    return df.join(drift, "frame", "left").withColumns({"x": F.col("x") + F.coalesce("dx", F.lit(0.0)), "y": F.col("y") + F.coalesce("dy", F.lit(0.0))}).drop("dx", "dy")


# --- fail counters: they depend on what was accepted before, so a frame is one group -------------------------------------


class FailCounter:
    """ok() says whether the frame goes on after the outcomes so far.

    A resetting counter keeps the share ``reset`` of its failures at a pass, rounded down; "and" and "or" combine the counters
    whose options are in ``parts``; a null counter never stops.
    """

    KINDS = ("consecutive", "pass_rate", "rolling", "weighted", "resetting", "and", "or", "null")

    def __init__(self, kind: str = "consecutive", allowed: int = 3, rate: float = 0.0, window: int = 5, fail: int = 1, good: int = 1, reset: float = 0.0, parts: tuple[dict, ...] = ()):
        if kind not in self.KINDS:
            raise ValueError(f"unknown fail counter {kind!r}")
        if not 0 <= reset <= 1:
            raise ValueError("reset must be from 0 to 1")
        if kind in ("and", "or") and not parts:
            raise ValueError(f"fail counter {kind!r} needs parts")
        self.kind, self.allowed, self.rate, self.window, self.fail, self.good, self.reset = kind, allowed, rate, window, fail, good, reset
        self.run = self.total = self.passed = self.score = self.kept = 0
        self.recent: list[bool] = []
        self.parts = [FailCounter(**p) for p in parts]

    def add(self, accepted: bool) -> None:
        self.total += 1
        self.passed += accepted
        self.run = 0 if accepted else self.run + 1
        self.score = max(0, self.score - self.good) if accepted else self.score + self.fail
        self.kept = int(self.kept * self.reset) if accepted else self.kept + 1
        self.recent = [*self.recent, accepted][-self.window :]
        for p in self.parts:
            p.add(accepted)

    def ok(self) -> bool:
        if self.kind == "consecutive":
            return self.run <= self.allowed
        if self.kind == "pass_rate":
            return self.total <= self.allowed or self.passed >= self.rate * self.total
        if self.kind == "rolling":
            return self.recent.count(False) <= self.allowed
        if self.kind == "weighted":
            return self.score <= self.allowed
        if self.kind == "resetting":
            return self.kept <= self.allowed
        if self.parts:
            return (all if self.kind == "and" else any)(p.ok() for p in self.parts)
        return True


def fail_count(df: DataFrame, accept: Column, rank: str = "rank", **options) -> DataFrame:
    """Rows accepted in rank order until a frame's counter says stop; what follows is rejected.

    A row stands when the counter held at it and at every row before.  Consecutive runs, pass rates, rolling windows and
    weighted scores are windows over the frame: a run is the rank less that of the last accepted row; a weighted score, which
    never falls below 0, is its running sum less the least running sum so far.  Resetting and combined counters are plain
    state and run per frame.
    """
    FailCounter(**options)  # options that do not hold are refused here, before any task
    kind, allowed = options.get("kind", "consecutive"), options.get("allowed", 3)
    marked = df.withColumn("_ok", F.coalesce(accept, F.lit(False)))
    if kind in ("consecutive", "pass_rate", "rolling", "weighted"):
        w = Window.partitionBy("frame").orderBy(rank)
        sofar = w.rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("_n", F.row_number().over(w))
        if kind == "consecutive":
            holds = F.col("_n") - F.coalesce(F.max(F.when(F.col("_ok"), F.col("_n"))).over(sofar), F.lit(0)) <= allowed
        elif kind == "pass_rate":
            good = F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(sofar)
            holds = (F.col("_n") <= allowed) | (good >= options.get("rate", 0.0) * F.col("_n"))
        elif kind == "rolling":
            holds = F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w.rowsBetween(1 - options.get("window", 5), 0)) <= allowed
        else:
            marked = marked.withColumn("_s", F.sum(F.when(F.col("_ok"), -options.get("good", 1)).otherwise(options.get("fail", 1))).over(sofar))
            holds = F.col("_s") - F.least(F.lit(0), F.min("_s").over(sofar)) <= allowed
        out = marked.withColumn("_holds", holds).withColumn("_all", F.min("_holds").over(sofar))
        return out.where("_ok AND _all").select(*df.columns)

    def frame(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(rank, kind="stable")
        counter, keep = FailCounter(**options), np.zeros(len(rows), bool)
        for k, good in enumerate(rows["_ok"]):
            if not counter.ok():
                break
            counter.add(bool(good))
            keep[k] = bool(good) and counter.ok()
        return rows[keep].drop(columns="_ok")

    return marked.groupBy("frame").applyInPandas(frame, df.schema)
