"""Shared scratch tables and connected components of edges too many for the driver."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's switch for deleting an execution's shuffle files when it ends; else they wait for the driver's garbage collector.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges that one task may take to their components; more go by rounds of joins.
LOCAL_EDGES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a new local one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spotlattice-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_table(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back.  Cuts the lineage and survives lost executors.

    The shuffles that made it are deleted at once: many steps one after another hold the disk of the largest, not of all.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/spotlattice/{uuid.uuid4().hex}.parquet", df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a shared table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_shared_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with dense numbers from 1 in order of the columns ``order``, which tell all rows apart.

    Rows are dealt by range and ranked in each part; the window that adds up the parts runs over one row a part.
    """
    parts = shared_table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = parts.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn(name, F.col("_rank") + F.col("_before")).drop("_range", "_rank", "_n", "_before")


def _trees(batches):
    """(node, component) of a bounded number of edges, by union and find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, rounds: int = 60, local: int | None = None) -> DataFrame:
    """(node, component) for every node of edges(a, b), long numbers; component is the smallest node that can be reached.

    Alternating large-star and small-star steps.  Every step is one grouped minimum, written to the shared folder, and one
    join of the edges with it: both sides of the join come from a table, so that AQE splits the partition of a hub (a
    grouped side would keep it from that).  Edges that are ``local`` or fewer, at the start or after a round, are finished
    by one task.
    """
    local = LOCAL_EDGES if local is None else local
    kept = edges.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    edges, before = shared_table(kept), None
    for _ in range(rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003)).first())
        if now[0] <= local:
            return edges.coalesce(1).mapInArrow(_trees, "node long, component long")
        if now == before:
            break
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each node hands its larger neighbours to its smallest neighbour (itself included)
        least = shared_table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = shared_table(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        # small star: each node hands its smaller neighbours and itself to the smallest of them
        low = shared_table(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(low, "b").select(F.col("m").alias("p"), F.explode(F.array("a", "b")).alias("q")).where("p <> q")
        old, edges = edges, shared_table(small.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
        for t in (old, least, large, low):
            forget(t)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    star = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return star.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
