"""Grouped summaries of localisations and of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.localisation import snr
from .graph import numbered


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])


def flags(df: DataFrame) -> DataFrame:
    """Which attributes any row has; precision counts only if every row has it."""
    some = {"has_noise": F.col("noise") > 0, "has_intensity": F.col("mean_intensity") > 0, "has_background": F.col("background") != 0, "has_category": F.col("category").isNotNull() & (F.col("category") != 0), "has_end_frame": F.col("end_frame") != F.col("frame"), "has_3d": F.col("z") != 0}
    return df.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in some.items()], F.coalesce(F.bool_and(F.col("precision").isNotNull()), F.lit(False)).alias("has_precision"), (F.countDistinct(F.when(F.col("id") != 0, F.col("id"))) > 1).alias("has_multiple_id"))


def summary(df: DataFrame, exposure_ms: float, by: str = "dataset") -> DataFrame:
    """Size, time, bounds, and mean, median, least and greatest of signal to noise and of precision."""
    s, p = snr(), F.col("precision")
    four = lambda c, n: [F.avg(c).alias(f"mean_{n}"), F.percentile(c, 0.5).alias(f"median_{n}"), F.min(c).alias(f"min_{n}"), F.max(c).alias(f"max_{n}")]
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.max("frame").alias("max_frame"), (F.max("frame") * exposure_ms / 1000).alias("seconds"), *four(s, "snr"), *four(p, "precision"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.bool_or(F.col("z") != 0).alias("is_3d"),
    )


def clusters(df: DataFrame, by: str = "id", weighted: bool = False) -> DataFrame:
    """Size, signal, centroid and spread about it; weights are absolute intensities.  One pass: moments, not two scans."""
    w = F.abs("intensity") if weighted else F.lit(1.0)
    spread = F.when(F.count("*") > 1, F.sqrt(F.var_samp("x") + F.var_samp("y"))).otherwise(0.0)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sum("intensity").alias("signal"), (F.sum(F.col("x") * w) / F.sum(w)).alias("cx"), (F.sum(F.col("y") * w) / F.sum(w)).alias("cy"), spread.alias("sd"))


def weighted_precision(df: DataFrame, by: str = "id") -> DataFrame:
    """Of a cluster from its rows' positions, precisions and photons; a single row's own precision.

    Moments are about the cluster's centre, which a window brings to its rows: one shuffle, and nothing cancels far from 0.
    """
    w, of = F.col("intensity"), Window.partitionBy(by)
    p = F.when(F.col("precision") > 0, F.col("precision")).otherwise(1.0)
    off = lambda c: F.col(c) - F.sum(w * F.col(c)).over(of) / F.sum(w).over(of)
    rows = df.select(by, "intensity", p.alias("_p"), off("x").alias("_x"), off("y").alias("_y"))
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col("_p") * F.col("_p")).alias("sp"), F.max("_p").alias("own"), *[F.sum(w * F.col(c) * F.col(c)).alias(f"q{c}") for c in ("_x", "_y")])
    axis = lambda c: F.sqrt((F.col(f"q{c}") + F.col("sp")) / F.col("w")) / F.sqrt(F.lit(2.0))
    return out.select(by, "n", F.when(F.col("n") == 1, F.col("own")).otherwise(F.greatest(axis("_x"), axis("_y"))).alias("precision"))


def centroids(df: DataFrame) -> DataFrame:
    """One row per track: mean background, root-sum-square noise, summed signal, span and centroid."""
    return df.groupBy("id").agg(
        F.avg("background").alias("background"), F.sqrt(F.sum(F.col("noise") * F.col("noise"))).alias("noise"), F.sum("intensity").alias("intensity"),
        F.min("frame").alias("frame"), F.max("end_frame").alias("end_frame"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"),
    )


def classification(df: DataFrame, accept: Column, by: list[str] | None = None) -> DataFrame:
    """Counts of true and false positives and negatives by the truth in orig_value."""
    truth, take = F.col("orig_value") != 0, F.coalesce(accept, F.lit(False))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(*(by or [])).agg(n(truth & take).alias("tp"), n(~truth & take).alias("fp"), n(~truth & ~take).alias("tn"), n(truth & ~take).alias("fn"))


def match_metrics(counts: DataFrame) -> DataFrame:
    """The usual scores of tp, fp, tn and fn; null where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    over = lambda a, b: F.when(b != 0, a / b)
    return counts.withColumns({
        "recall": over(tp, tp + fn), "precision": over(tp, tp + fp), "jaccard": over(tp, tp + fp + fn), "f1": over(2 * tp, 2 * tp + fp + fn), "fnr": over(fn, tp + fn),
        "fdr": over(fp, tp + fp), "tnr": over(tn, tn + fp), "npv": over(tn, tn + fn), "fpr": over(fp, tn + fp), "accuracy": over(tp + tn, tp + tn + fp + fn),
        "mcc": over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "informedness": over(tp, tp + fn) + over(tn, tn + fp) - 1,
    })


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rand and adjusted Rand index of two labellings, from their contingency counts."""
    two = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias(f"s_{c}"))
    total = cells.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    one = total.join(side(a), how="left", on=F.lit(True)).join(side(b), how="left", on=F.lit(True))  # each side is one row
    pairs, sa, sb, both = two(F.col("n")), F.col(f"s_{a}"), F.col(f"s_{b}"), F.col("both")
    expected = sa * sb / pairs
    return one.select(((pairs + 2 * both - sa - sb) / pairs).alias("rand"), F.when((sa + sb) / 2 != expected, (both - expected) / ((sa + sb) / 2 - expected)).alias("adjusted_rand"))


def radial_average(df: DataFrame, r: Column, value: str) -> DataFrame:
    return df.groupBy(F.round(r).cast("int").alias("radius")).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


def filter_grid(df: DataFrame, grid: list[dict], conditions) -> DataFrame:
    """Scores of many filters in one scan: conditions(params) is a Column; counts of all filters are one aggregation."""
    truth = F.col("orig_value") != 0
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = []
    for k, params in enumerate(grid):
        take = F.coalesce(conditions(params), F.lit(False))
        rows.append(F.struct(F.lit(k).alias("filter_id"), n(truth & take).alias("tp"), n(~truth & take).alias("fp"), n(~truth & ~take).alias("tn"), n(truth & ~take).alias("fn")))
    return df.agg(F.array(*rows).alias("_f")).select(F.inline("_f"))


def render(df: DataFrame, scale: float, mode: str = "add", weighted: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """Super-resolution raster: (px, py, value) by sum, maximum or last row; ``weighted`` spreads over four pixels.

    With ``on``, one raster for each value of those columns.
    """
    x, y = F.col("x") * scale, F.col("y") * scale
    if weighted:
        x0, y0 = F.floor(x - 0.5), F.floor(y - 0.5)
        fx, fy = x - 0.5 - x0, y - 0.5 - y0
        parts = [F.struct((x0 + i).cast("int").alias("px"), (y0 + j).cast("int").alias("py"), (F.col("intensity") * (fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("v")) for i in (0, 1) for j in (0, 1)]
        rows = df.select("row_id", *on, F.inline(F.array(*parts)))
    else:
        rows = df.select("row_id", *on, F.floor(x).cast("int").alias("px"), F.floor(y).cast("int").alias("py"), F.col("intensity").alias("v"))
    value = {"add": F.sum("v"), "max": F.max("v"), "replace": F.max_by("v", "row_id")}[mode]
    return rows.groupBy(*on, "px", "py").agg(value.alias("value"))


def dense_ids(*datasets: DataFrame) -> DataFrame:
    """Union of tracked datasets with ids renumbered densely in order of (dataset, id).

    The numbers are ranks within each dataset, taken in parts by range, plus the count of ids before it.
    """
    out, before = None, 0
    for k, df in enumerate(datasets):
        ids = numbered(df.select("id").distinct(), "id", name="_new").withColumn("_new", F.col("_new") + before)
        part = df.join(ids, "id").withColumn("id", F.col("_new")).drop("_new").withColumn("dataset", F.lit(k))
        before += ids.count()
        out = part if out is None else out.unionByName(part)
    return out


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("row_id"), "row_id", "left_anti")


def retain_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("row_id"), "row_id", "left_semi")
