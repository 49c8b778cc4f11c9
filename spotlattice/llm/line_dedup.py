"""Line dedup: hash normalised lines, count the documents of each hash, drop repeated lines, reassemble by position.

Defined results: a null or empty text is one empty line; lines shorter than ``min_chars`` never count; rows that repeat a
document id are one document (a line is not a repeat of itself there); rows with a null id keep every line and make no
line a repeat; an empty table gives an empty table.  Input columns may have any names: only the id and the text are read
by name, the others travel in one struct.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, shared_table

_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes that stand for the normalised line; None where it is too short to count."""
    key = line.strip(_STRIP).lower()  # bytes.lower changes A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _occurrences(min_chars: int):
    """Of (id, text): each document's distinct line keys."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {line_key(x, min_chars) for x in (text or b"").split(b"\n")} - {None}
                ids += [i] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["_id", "_key"])

    return run


def _reassemble(min_chars: int, digest: bool):
    """Of (id, text, keys to drop, rest): the lines that stay, in their order."""

    def run(batches):
        for batch in batches:
            n, dropped, kept = [], [], []
            for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                gone = set(keys or ())
                stay = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                n.append(len(lines))
                dropped.append(len(lines) - len(stay))
                whole = b"\n".join(stay)
                kept.append(hashlib.sha256(whole).hexdigest().encode() if digest else whole if text is not None else None)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(out, ["_id", "_n", "_dropped", "_kept", "_rest"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, digest: bool = False, rest: list[str] | None = None) -> DataFrame:
    """(_id, _n, _dropped, _kept, _rest): per row its lines before, those dropped, what is kept (or its SHA-256), other columns.

    A key found in ``min_docs`` documents or more stays only in the smallest document id that holds it.  Two shuffles of
    (id, key), both after a map-side step: the count is a partial aggregate, so that a line of every document leaves one
    row a task.  The keys found, and each document's keys to drop, are stored before they are joined: both sides of a join
    then come from tables, and AQE splits the partition of a hot key or id (a grouped side would keep it from that).  The
    texts move once, to meet their own keys.  Both joins are alike at every size: the side that is
    built holds keys alone, of one partition, and the texts stream past it.
    """
    packed = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("binary").alias("_text"), F.struct(F.lit(0).alias("_none"), *[docs[c] for c in rest or []]).alias("_rest"))
    seen = map_texts(packed.where("_id is not null").select("_id", "_text"), _occurrences(min_chars), "_id long, _key binary")
    if min_docs == 2:
        keys = seen.groupBy("_key").agg(F.min("_id").alias("_keeper"), F.max("_id").alias("_last")).where("_keeper < _last")
    else:
        keys = seen.groupBy("_key").agg(F.min("_id").alias("_keeper"), F.countDistinct("_id").alias("_docs")).where(F.col("_docs") >= min_docs)
    lost = seen.join(shared_table(keys.select("_key", "_keeper")).hint("shuffle_hash"), "_key").where("_id <> _keeper")
    drops = shared_table(lost.groupBy("_id").agg(F.collect_set("_key").alias("_keys")))
    met = packed.join(drops.hint("shuffle_hash"), "_id", "left").select("_id", "_text", "_keys", "_rest")
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_dropped", T.LongType()), T.StructField("_kept", T.BinaryType()), met.schema["_rest"]])
    return map_texts(met, _reassemble(min_chars, digest), schema).withColumn("_kept", F.col("_kept").cast("string"))


def dedup_texts(docs: DataFrame, **options) -> DataFrame:
    """docs with the same columns, the text without its repeated lines."""
    text = options.get("text_col", "text")
    out = line_dedup(docs, rest=docs.columns, **options)
    return out.select(*[(F.col("_kept") if c == text else F.col("_rest").getField(c)).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return line_dedup(docs, digest=True).select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_kept").alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.doc_id, k.pos, k.line, g.keeper IS NOT NULL AND g.keeper <> k.doc_id AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
