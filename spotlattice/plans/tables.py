"""The driver's tables seen as localisations, in Spark and in SQL.

lineitem: a track is an order, a frame is a ship date, position and signal come from quantity and price.
events: a track is a user, a frame is an hour.  embeddings: points of the first two components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOC = {
    "row_id": "(l_orderkey * 16 + l_linenumber) * 1048576 + l_partkey", "id": "l_orderkey", "frame": "{day}", "end_frame": "{day} + l_linenumber % 3", "x": "l_quantity", "y": "l_extendedprice / 1000",
    "z": "l_discount", "intensity": "l_extendedprice", "background": "l_discount * 100", "noise": "l_tax * 100", "mean_intensity": "l_extendedprice / 50", "category": "CAST(l_suppkey % 4 AS INT)",
    "orig_value": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "sx": "1 + l_discount", "sy": "1 + l_tax", "precision": "CASE WHEN l_linenumber = 7 THEN NULL ELSE 10 + l_tax * 100 END",
}
_SPARK_DAY, _DUCK_DAY = "datediff(to_date(l_shipdate), DATE'1992-01-01')", "CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INT)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def localisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("'lineitem' AS dataset", *[f"{e.format(day=_SPARK_DAY)} AS {n}" for n, e in _LOC.items()])


#: Common table expression ``loc`` for the SQL of queries over localisations.
LOC = "WITH loc AS (SELECT " + ", ".join(f"{e.format(day=_DUCK_DAY)} AS {n}" for n, e in _LOC.items()) + ", 'lineitem' AS dataset FROM lineitem)"


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as localisations: one id a user, one frame an hour."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("id"), F.expr("CAST(unix_seconds(CAST(ts AS TIMESTAMP)) div 3600 AS INT)").alias("frame"), F.col("value").alias("intensity"), (F.col("value") % 10).alias("x"), (F.col("user_id") % 50).cast("double").alias("y")).withColumn("end_frame", F.col("frame"))


EV = "WITH ev AS (SELECT event_id AS row_id, user_id AS id, CAST(floor(epoch(ts) / 3600) AS INT) AS frame, value AS intensity, value % 10 AS x, CAST(user_id % 50 AS DOUBLE) AS y FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as points in the plane, on a scale of hundreds."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), (F.get("embedding", F.lit(0)).cast("double") * 100).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 100).alias("y"), F.lit(1).alias("frame"), F.lit(1).alias("end_frame"), F.col("label").alias("id"), (F.col("label") + 1.0).alias("intensity"))


PT = "WITH pt AS (SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, label AS id FROM embeddings)"
