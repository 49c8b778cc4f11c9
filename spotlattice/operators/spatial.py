"""Spatial joins by grid cells, and what is built on them: neighbours, density, pair correlation, clusters.

A join within distance d is an equi-join on cells of side d: one side keeps its cell, the other is dealt to the 3 x 3 cells
around.  Only rows of neighbouring cells ever meet, and AQE can split a crowded cell, which both sides reach by a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.localisation import distance2
from .closest import match_groups, sides
from .graph import connected_components, shared_table

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def within(a: DataFrame, b: DataFrame, d: float, on: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Pairs (a_*, b_*, d2) of rows at most d apart (closer, if strict) that agree on the columns ``on``."""
    cell = lambda c: F.floor(F.col(c) / d)
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], cell("x").alias("_cx"), cell("y").alias("_cy"), *[F.col(c).alias(f"_k_{c}") for c in on])
    spread = F.explode(F.array(*[F.struct((cell("x") + i).alias("x"), (cell("y") + j).alias("y")) for i, j in AROUND]))
    right = b.withColumn("_at", spread).select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.col("_at.x").alias("_cx"), F.col("_at.y").alias("_cy"), *[F.col(c).alias(f"_k_{c}") for c in on])
    keys = ["_cx", "_cy", *[f"_k_{c}" for c in on]]
    met = left.join(right, keys).withColumn("d2", distance2("a_x", "a_y", "b_x", "b_y")).drop(*keys)
    return met.where(F.col("d2") < d * d if strict else F.col("d2") <= d * d)


def within_key(a: DataFrame, b: DataFrame, d: float, key: str, strict: bool = False) -> DataFrame:
    """The pairs of ``within`` where a key leaves few partners: a plain equi-join on it, without cells."""
    left, right = (t.select(*[F.col(c).alias(f"{n}_{c}") for c in t.columns], F.col(key).alias("_k")) for t, n in ((a, "a"), (b, "b")))
    met = left.join(right, "_k").withColumn("d2", distance2("a_x", "a_y", "b_x", "b_y")).drop("_k")
    return met.where(F.col("d2") < d * d if strict else F.col("d2") <= d * d)


def neighbours(df: DataFrame, d: float, frames: int) -> DataFrame:
    """Per row its brightest other row closer than d in the frames around: by end before, by start after.  Ties: first row."""
    rows = df.select("row_id", "frame", "end_frame", "x", "y", "intensity")
    near = within(rows, rows, d, strict=True)
    before = (F.col("b_end_frame") >= F.col("a_frame") - frames) & (F.col("b_end_frame") < F.col("a_frame"))
    after = (F.col("b_frame") > F.col("a_frame")) & (F.col("b_frame") <= F.col("a_frame") + frames)
    best = near.where(before | after).groupBy("a_row_id").agg(F.max_by(F.struct("b_row_id", "b_intensity", "d2"), F.struct("b_intensity", -F.col("b_row_id"))).alias("_b"))
    return best.select(F.col("a_row_id").alias("row_id"), F.col("_b.b_row_id").alias("neighbour"), F.sqrt("_b.d2").alias("distance"))


def ripley(df: DataFrame, radius: float, area: float) -> DataFrame:
    """Per row the count of others within the radius, and K, L and L - r from it."""
    n = df.count()
    density = n / area
    rows = df.select("row_id", "x", "y")
    counts = within(rows, rows, radius).where("a_row_id <> b_row_id").groupBy(F.col("a_row_id").alias("row_id")).agg(F.count("*").alias("n"))
    k = F.col("n") / density
    return rows.join(counts, "row_id", "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n")).withColumns({"k": k, "l": F.sqrt(k / math.pi), "l_minus_r": F.sqrt(k / math.pi) - radius})


def pair_correlation(df: DataFrame, radius: float, step: float, inner: tuple[float, float, float, float] | None = None) -> DataFrame:
    """g(r) in rings of width ``step`` around the centres inside a box, in units of pairs per area and centre.

    Without a box, centres are all rows at least ``radius`` inside the bounds of the rows, so that no ring is cut by an edge.
    """
    rows = df.select("row_id", "x", "y")
    if inner is None:
        placed = rows.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))  # NaN is above all numbers
        x0, x1, y0, y1 = placed.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if x0 is not None and (x1 - x0 <= 2 * radius or y1 - y0 <= 2 * radius):
            raise ValueError(f"no centre is {radius} inside bounds of {x1 - x0} by {y1 - y0}")
        inner = (0.0, 0.0, 0.0, 0.0) if x0 is None else (x0 + radius, x1 - radius, y0 + radius, y1 - radius)
    x0, x1, y0, y1 = inner
    centres = rows.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    n = centres.count()
    rings = within(centres, rows, radius, strict=True).where("a_row_id <> b_row_id").groupBy(F.floor(F.sqrt("d2") / step).alias("ring")).agg(F.count("*").alias("pairs"))
    area = math.pi * step * step * (F.pow(F.col("ring") + 1, 2) - F.pow("ring", 2))
    return rings.select("ring", "pairs", (F.col("pairs") / (n * area)).alias("g"))


def single_linkage(df: DataFrame, d: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, cluster): components of rows at most d apart; a cluster is named by its smallest row.

    Rows of a cell whose diagonal is d hang together, so its smallest row stands for it: edges run between cells, however
    many rows and pairs they hold.
    """
    rows = df.select("row_id", "x", "y", *on).withColumns({c: F.floor(F.col(p) * math.sqrt(2) * (1 + 1e-12) / d) for c, p in (("_gx", "x"), ("_gy", "y"))})
    heads = rows.groupBy("_gx", "_gy", *on).agg(F.min("row_id").alias("_head"))
    rows = shared_table(rows.join(heads, ["_gx", "_gy", *on], "left").withColumn("_head", F.coalesce("_head", "row_id")).select("row_id", "_head", "x", "y", *on))
    pairs = within(rows, rows, d, on).where("a__head < b__head")
    groups = connected_components(pairs.select(F.col("a__head").alias("a"), F.col("b__head").alias("b")).distinct()).withColumnRenamed("node", "_head")
    return rows.select("row_id", "_head").join(groups, "_head", "left").select("row_id", F.coalesce("component", "_head").alias("cluster"))


def dbscan(df: DataFrame, d: float, min_points: int) -> DataFrame:
    """(row_id, cluster, core): cores have min_points rows in reach, themselves included; borders join their nearest core.

    Noise has a null cluster.  Two joins over the same cells; components of cores only.
    """
    rows = shared_table(df.select("row_id", "x", "y"))
    counts = within(rows, rows, d).groupBy(F.col("a_row_id").alias("row_id")).agg((F.count("*") >= min_points).alias("core"))
    marked = shared_table(rows.join(counts, "row_id"))
    cores = marked.where("core")
    edges = within(cores, cores, d).where("a_row_id < b_row_id").select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"))
    groups = cores.select("row_id").join(connected_components(edges).withColumnRenamed("node", "row_id"), "row_id", "left").select("row_id", F.coalesce("component", "row_id").alias("cluster"))
    nearest = within(marked.where("NOT core"), cores, d).groupBy("a_row_id").agg(F.min_by("b_row_id", F.struct("d2", "b_row_id")).alias("_c"))
    borders = nearest.join(groups.withColumnRenamed("row_id", "_c"), "_c").select(F.col("a_row_id").alias("row_id"), "cluster")
    return marked.select("row_id", "core").join(groups.union(borders), "row_id", "left").select("row_id", "cluster", "core")


def density_regions(df: DataFrame, border: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows over the union of their (2 border + 1)-sided squares, per cluster of overlapping squares, on whole pixels.

    With ``on``, squares of different values (of frames, say) do not overlap.
    """
    pixels = df.select("row_id", *on, F.col("x").cast("int").alias("px"), F.col("y").cast("int").alias("py"))
    reach = range(-border, border + 1)
    squares = pixels.select("row_id", *on, F.inline(F.array(*[F.struct((F.col("px") + i).alias("qx"), (F.col("py") + j).alias("qy")) for i in reach for j in reach])))
    heads = squares.groupBy(*on, "qx", "qy").agg(F.min("row_id").alias("a"))
    edges = squares.join(heads, [*on, "qx", "qy"]).where("row_id <> a").select("a", F.col("row_id").alias("b")).distinct()
    groups = connected_components(edges).withColumnRenamed("node", "row_id")
    of = pixels.select("row_id").distinct().join(groups, "row_id", "left").select("row_id", F.coalesce("component", "row_id").alias("cluster"))
    area = squares.join(of, "row_id").groupBy(*on, "cluster").agg(F.countDistinct("qx", "qy").alias("area"), F.countDistinct("row_id").alias("n"))
    return area.select(*on, "cluster", "n", "area", (F.col("n") / F.col("area")).alias("density"))


def local_density(df: DataFrame, border: int) -> DataFrame:
    """(cluster, n, area, density) of all rows together."""
    return density_regions(df, border)


def density_estimate(regions: DataFrame, singles: bool = True) -> DataFrame:
    """(regions, singles, density, mean, sd): rows over area of all regions; the mean and deviation of their own densities.

    Regions of a single row count as singles, and not otherwise unless ``singles``.
    """
    kept = F.lit(True) if singles else F.col("n") > 1
    of = lambda c: F.when(kept, F.col(c))
    return regions.agg(
        F.count(of("n")).alias("regions"), F.count(F.when(F.col("n") == 1, 1)).alias("singles"), (F.sum(of("n")) / F.sum(of("area"))).alias("density"), F.avg(of("density")).alias("mean"), F.stddev_samp(of("density")).alias("sd")
    )


def ripley_forms(df: DataFrame, radius: float, area: float, square: bool = False) -> DataFrame:
    """The scores of local density: count, K over density and over area, L, L - r, L / r and (L - r) / r.

    ``square`` counts within a square of twice the radius, whose area has the factor 4 for pi.
    """
    rows = df.select("row_id", "x", "y")
    density = rows.count() / area
    near = within(rows, rows, radius * math.sqrt(2) if square else radius).where("a_row_id <> b_row_id")
    if square:
        near = near.where((F.abs(F.col("a_x") - F.col("b_x")) <= radius) & (F.abs(F.col("a_y") - F.col("b_y")) <= radius))
    counts = near.groupBy(F.col("a_row_id").alias("row_id")).agg(F.count("*").alias("n"))
    factor = 4.0 if square else math.pi
    k = F.col("n") / density
    length = F.sqrt(k / factor)
    out = rows.select("row_id").join(counts, "row_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("row_id", "n", k.alias("k"), (k / (factor * radius * radius)).alias("k_area"), length.alias("l"), (length - radius).alias("l_minus_r"), (length / radius).alias("l_ratio"), (length / radius - 1).alias("l_excess"))


def erf(x: Column) -> Column:
    """The error function of x >= 0 by a rational approximation, within 2e-7."""
    t = 1 / (1 + 0.3275911 * x)
    return 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def outlier_scores(df: DataFrame, k: int, reach: float, scale: float = 3.0) -> DataFrame:
    """(row_id, plof, score): how much farther a row's ``k`` nearest others (within reach) are than theirs are, and the
    probability that it is an outlier.  Rows without another in reach have the score 1 and no plof."""
    rows = df.select("row_id", "x", "y")
    near = within(rows, rows, reach).where("a_row_id <> b_row_id").withColumn("_k", F.row_number().over(Window.partitionBy("a_row_id").orderBy("d2", "b_row_id")))
    near = shared_table(near.where(F.col("_k") <= k).select(F.col("a_row_id").alias("row_id"), F.col("b_row_id").alias("_b"), "d2"))
    spread = shared_table(near.groupBy("row_id").agg(F.sqrt(F.avg("d2")).alias("_p")))
    others = near.join(spread.withColumnRenamed("row_id", "_b"), "_b").groupBy("row_id").agg(F.avg("_p").alias("_o"))
    plof = shared_table(spread.join(others, "row_id").select("row_id", (F.col("_p") / F.col("_o") - 1).alias("plof")))
    norm = plof.agg(F.sqrt(F.avg(F.col("plof") * F.col("plof"))).alias("n")).first()["n"] or 0.0
    score = F.when(F.col("plof") <= 0, 0.0).otherwise(erf(F.col("plof") / F.lit(scale * norm * math.sqrt(2) or 1.0)))
    return rows.select("row_id").join(plof.withColumn("score", score), "row_id", "left").select("row_id", "plof", F.coalesce("score", F.lit(1.0)).alias("score"))


def match_frames(actual: DataFrame, predicted: DataFrame, d: float) -> DataFrame:
    """One-to-one matches per frame by closest first: (frame, a_row_id, b_row_id, distance); ties by the smaller row ids.

    A task holds the rows of one frame, and no pairs are stored.
    """
    frame = lambda df: df.select("row_id", "x", "y", "frame", F.col("frame").alias("end_frame"))
    found = match_groups(sides(frame(actual), frame(predicted)).withColumn("group", F.col("frame")), d)
    return found.select(F.col("group").cast(actual.schema["frame"].dataType).alias("frame"), "a_row_id", "b_row_id", F.sqrt("d2").alias("distance"))


def reach_groups(rows: DataFrame, d: float) -> DataFrame:
    """rows with ``group``: those that chains of occupied cells of side d tie together have the same."""
    cell = lambda c: F.floor(F.col(c) / (d * (1 + 1e-9)))
    rows = shared_table(rows.withColumns({"_cx": cell("x"), "_cy": cell("y")}).withColumn("_cell", F.xxhash64("_cx", "_cy")))
    cells = shared_table(rows.select("_cx", "_cy", "_cell").distinct())
    beside = F.explode(F.array(*[F.xxhash64(F.col("_cx") + i, F.col("_cy") + j) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    edges = cells.select(F.col("_cell").alias("a"), beside.alias("b")).join(cells.select(F.col("_cell").alias("b")), "b")
    groups = connected_components(edges.select("a", "b")).withColumnRenamed("node", "_cell")
    return rows.join(groups, "_cell", "left").withColumn("group", F.coalesce("component", "_cell")).drop("_cx", "_cy", "_cell", "component")


def unmix_channels(df: DataFrame, radius: float, c12: float, c21: float) -> DataFrame:
    """(row_id, o1, o2, d1, d2, channel): counts of both channels within a radius (the row itself included), freed of
    crosstalk, and the channel that is stronger then; ties keep the row's own.  Rows of other channels are left out."""
    from ..functions.localisation import unmix2

    rows = df.where("channel IN (1, 2)").select("row_id", "channel", "x", "y")
    count = lambda k: F.count(F.when(F.col("b_channel") == k, 1)).alias(f"o{k}")
    seen = within(rows, rows, radius).groupBy(F.col("a_row_id").alias("row_id"), F.col("a_channel").alias("_own")).agg(count(1), count(2))
    d1, d2 = unmix2("o1", "o2", c12, c21)
    out = seen.withColumns({"d1": d1, "d2": d2})
    return out.withColumn("channel", F.when(F.col("d1") > F.col("d2"), 1).when(F.col("d1") < F.col("d2"), 2).otherwise(F.col("_own"))).drop("_own")
