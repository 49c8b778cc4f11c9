"""Helpers shared by the corpus operators; shared tables and components come from the library."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlattice.operators.graph import connected_components, forget, partitions, shared_table

__all__ = ["Recent", "by_chunks", "connected_components", "forget", "map_texts", "partitions", "shared_table"]
#: Rows of an Arrow batch of whole texts; Spark also bounds a batch's bytes (arrow.maxBytesPerBatch, 64 MB).
TEXT_ROWS = 512


def map_texts(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, in batches small enough for whole texts.

    The session's limit is lowered where it is higher, and stays so: Spark reads it when the plan is run, later than this.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df.mapInArrow(function, schema)


class Recent(dict):
    """Values by key, made when first asked for; those asked for lately are kept, in two generations of ``most`` keys."""

    def __init__(self, make: Callable, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def by_chunks(docs: DataFrame, make: Callable, schema: str, chunk: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (_id, *schema) for each row of docs, by the three steps of the object that ``make()`` returns in a worker.

    ``cut(text, chunk)`` gives pieces, ``part(piece)`` what one piece comes to, and ``join(parts)`` the columns from the
    parts in order.  The steps are the same for every text.  Texts within one chunk take them where they are read; the
    pieces of longer texts are dealt to all tasks, and their parts meet by a grouped aggregate (repeated rows once, with
    their number).  So short texts cross no shuffle, and a huge text is as many tasks' work as it has chunks.
    """
    names = [c.split()[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(",")]

    def rows(ids, joined: list[tuple]) -> pa.RecordBatch:
        columns = zip(*joined, strict=True) if joined else [[]] * len(names)
        return pa.RecordBatch.from_arrays([ids, *[pa.array(list(x), t) for x, t in zip(columns, types, strict=True)]], ["_id", *names])

    def whole(batches):
        m = make()
        for batch in batches:
            yield rows(batch.column(0), [m.join([m.part(p) for p in m.cut(t, chunk)]) for t in batch.column(1).to_pylist()])

    def cut(batches):
        m = make()
        for batch in batches:
            for k in range(batch.num_rows):
                i, text, key = (c.slice(k, 1) for c in batch.columns)
                pieces = m.cut(text[0].as_py(), chunk)
                for at in range(0, len(pieces), 64):
                    few = pieces[at : at + 64]
                    same = lambda x: pa.concat_arrays([x] * len(few))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(i), same(key), pa.array(range(at, at + len(few)), pa.int64()), pa.array(few, pa.string())], ["_id", "_key", "_chunk", "_text"])

    def part(batches):
        m = make()
        for batch in batches:
            parts = pa.array([pickle.dumps(m.part(t)) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], parts], ["_id", "_key", "_chunk", "_part"])

    def join(batches):
        m = make()
        for batch in batches:
            joined = []
            for found in batch.column(2).to_pylist():
                of = {x["_chunk"]: x["_part"] for x in found}
                joined.append(m.join([pickle.loads(of[k]) for k in sorted(of)]))
            out = rows(batch.column(0), joined)
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column(1)], [*out.schema.names, "_times"])

    texts = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    short = map_texts(texts.where(F.length("_text") <= chunk), whole, f"_id long, {schema}")
    long = texts.where(F.length("_text") > chunk).withColumn("_key", F.md5(F.col("_text").cast("binary")))
    dealt = long.mapInArrow(cut, "_id long, _key string, _chunk long, _text string").repartition(partitions(docs), "_id", "_key", "_chunk")
    parts = map_texts(dealt, part, "_id long, _key string, _chunk long, _part binary")
    met = parts.groupBy("_id", "_key").agg(F.sum(F.when(F.col("_chunk") == 0, 1)).alias("_times"), F.collect_set(F.struct("_chunk", "_part")).alias("_parts"))
    joined = map_texts(met.select("_id", "_times", "_parts"), join, f"_id long, {schema}, _times long")
    return short.union(joined.withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).select("_id", *names))
