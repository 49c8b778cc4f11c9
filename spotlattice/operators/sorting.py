"""The orders of result tables.  A table has no order of its own in Spark: an order is a numbering, or the sort of a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import numbered

#: Columns of each order and whether they fall; the row id tells equal rows apart.
ORDERS: dict[str, list[tuple[str, bool]]] = {
    "frame": [("frame", False), ("intensity", True), ("end_frame", False)],
    "frame_id": [("frame", False), ("id", False)],
    "id_frame": [("id", False), ("frame", False)],
    "end": [("end_frame", False)],
}


def columns_of(order: str) -> list[Column]:
    return [F.desc(c) if falls else F.asc(c) for c, falls in [*ORDERS[order], ("row_id", False)]]


def sorted_rows(df: DataFrame, order: str = "frame") -> DataFrame:
    """The rows in one of the ORDERS, by a range partitioning."""
    return df.orderBy(*columns_of(order))


def numbered_by(df: DataFrame, order: str = "frame", name: str = "k") -> DataFrame:
    """The rows with their place (from 1) in one of the ORDERS; no window runs over all rows."""
    falling = [c for c, falls in ORDERS[order] if falls]
    keyed = df.withColumns({f"_minus_{c}": -F.col(c) for c in falling})
    by = [f"_minus_{c}" if c in falling else c for c, _ in ORDERS[order]]
    return numbered(keyed, *by, "row_id", name=name).drop(*[f"_minus_{c}" for c in falling])


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """The rows in an order that depends on the row id and the seed alone."""
    return df.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id")
