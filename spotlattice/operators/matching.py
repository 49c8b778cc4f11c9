"""Match calculators: rows by frame, traces by place and time, labels of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closest import match_groups, places, sides
from .graph import shared_table
from .spatial import match_frames, reach_groups

COORDINATES = ("first", "last", "first_or_last", "all")


def in_frames(df: DataFrame, coordinates: str = "all") -> DataFrame:
    """One row for each frame in which a row counts: its first, its last, both (once where they are one), or all it spans."""
    if coordinates not in COORDINATES:
        raise ValueError(f"unknown coordinates {coordinates!r}")
    frames = {"first": F.array("frame"), "last": F.array("end_frame"), "first_or_last": F.array_distinct(F.array("frame", "end_frame")), "all": F.sequence("frame", "end_frame")}[coordinates]
    return df.withColumn("frame", F.explode(frames)).withColumn("end_frame", F.col("frame"))


def match_scores(actual: DataFrame, predicted: DataFrame, d: float, coordinates: str = "all") -> DataFrame:
    """(tp, fp, fn, recall, precision, jaccard) of a closest-first match in each frame."""
    a, b = (shared_table(in_frames(t, coordinates).select("row_id", "frame", "x", "y")) for t in (actual, predicted))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(match_frames(a, b, d), "tp").join(n(a, "na"), how="left", on=F.lit(True)).join(n(b, "nb"), how="left", on=F.lit(True))  # one row each
    over = lambda x, y: F.when(y > 0, x / y)
    tp, na, nb = F.col("tp"), F.col("na"), F.col("nb")
    return counts.select("tp", (nb - tp).alias("fp"), (na - tp).alias("fn"), over(tp, na).alias("recall"), over(tp, nb).alias("precision"), over(tp, na + nb - tp).alias("jaccard"))


def traces(df: DataFrame) -> DataFrame:
    """(row_id, x, y, frame, end_frame): a row a trace, named by its id, at its centre over its whole time."""
    return df.groupBy(F.col("id").alias("row_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("frame").alias("frame"), F.max("end_frame").alias("end_frame"))


def match_traces(actual: DataFrame, predicted: DataFrame, d: float, min_overlap: int = 1) -> DataFrame:
    """(a_row_id, b_row_id, distance, overlap): traces matched closest first among those at least ``min_overlap`` frames
    of which are common."""
    found = match_groups(reach_groups(places(sides(traces(actual), traces(predicted))), d), d, min_overlap)
    return found.select("a_row_id", "b_row_id", F.sqrt("d2").alias("distance"), "overlap")


def confusion(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(expected, found, n) over rows (row_id, label) that both have."""
    met = expected.select("row_id", F.col("label").alias("expected")).join(found.select("row_id", F.col("label").alias("found")), "row_id")
    return met.groupBy("expected", "found").agg(F.count("*").alias("n"))


def agreement(counts: DataFrame) -> DataFrame:
    """(n, agree, accuracy, kappa) of confusion counts; kappa is null where chance agrees with everything."""
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("expected") == F.col("found"), F.col("n")).otherwise(0)).alias("agree"))
    side = lambda c: counts.groupBy(F.col(c).alias("label")).agg(F.sum("n").cast("double").alias(c))
    chance = side("expected").join(side("found"), "label").agg(F.coalesce(F.sum(F.col("expected") * F.col("found")), F.lit(0.0)).alias("s"))
    one = total.join(chance, how="left", on=F.lit(True))  # one row each
    a, e = F.col("agree") / F.col("n"), F.col("s") / F.col("n") / F.col("n")
    return one.select("n", "agree", a.alias("accuracy"), F.when(e < 1, (a - e) / (1 - e)).alias("kappa"))
