"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes; rows that share a path are versions of it.  The ledger is
a table of (blob, rules version, spans) in the shared folder.  ``update`` takes the pairs that it holds out by an anti join,
scans one version of each blob that is left and appends what it found (blobs without findings too); ``scan`` joins the
stored findings back to all paths.  A second run over the same table scans nothing, new rules scan everything once.

Offsets come from the gaps that ``split`` leaves around the matches of ``regexp_extract_all``, so they are code points and
no Python runs.  Matches become rows, whose running sum of lengths over the blob is their position: linear in the matches.

Defined results: a null text is empty; a null id is a path like any other; repeated rows each get their blob's findings;
an empty table gives an empty table; other columns are not read (``redact`` carries them).
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlattice.operators.graph import shared_dir

from .common import partitions

#: Kind, pattern, and the condition a match ``m`` must meet, in the order that breaks ties of start.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    ("access", r"AKIA[A-Z0-9]{16,}", lambda m: F.length(m) >= 20),
    ("hex", r"[0-9a-f]{24,}", lambda m: F.length(m) >= 24),
]
RULES_VERSION = hashlib.sha256(repr([r[:2] for r in RULES]).encode()).hexdigest()[:16]
#: ``clear``: where the spans before this one (by start) end, so that what lies between is known from one span.
SPAN = "struct<start:int,kind_no:int,end:int,kind:string,clear:int>"
LEDGER = f"blob binary, rules string, spans array<{SPAN}>"
MATCH = "struct<kind_no:int,at:int,gap:int,size:int,good:boolean>"
#: Code points of a block when a text is cut at its spans.
BLOCK = 512


def _matches(text: Column, kind_no: int, pattern: str, valid) -> Column:
    """The matches of one kind with the length of the gap before each.  The guard keeps the two passes off other texts."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))

    def match(x: Column, k: Column) -> Column:
        return F.struct(F.lit(kind_no).alias("kind_no"), k.alias("at"), x["gap"].alias("gap"), F.length(x["m"]).alias("size"), valid(x["m"]).alias("good"))

    found = F.filter(pairs, lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(found, match)).otherwise(F.array()).cast(f"array<{MATCH}>")


def _addressed(versions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(versions[text_col], F.lit(""))
    path = versions[id_col].cast("long")
    return versions.select(path.alias("_id"), F.coalesce(path, F.lit(-(2**63))).alias("_at"), text.alias("_text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_blob"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(blob, rules, spans) of each blob that ``ledger`` has not under these rules.  Appended to the ledger, it completes it.

    Texts move once, to meet the (path, blob) that stands for their blob; a hot blob stands once (the side that is built
    holds 48 bytes a blob of one partition).  Then only its matches move.
    """
    v = _addressed(versions, id_col, text_col)
    stands = v.groupBy("_blob").agg(F.min("_at").alias("_at"))  # one row a blob and task goes to the shuffle
    if ledger is not None:
        stands = stands.join(ledger.where(F.col("rules") == RULES_VERSION).select(F.col("blob").alias("_blob")), "_blob", "left_anti")
    texts = v.select("_at", "_blob", "_text").join(stands.hint("shuffle_hash"), ["_at", "_blob"]).select("_blob", "_text")
    found = texts.select("_blob", F.explode_outer(F.concat(*[_matches(F.col("_text"), n, rule[1], rule[2]) for n, rule in enumerate(RULES)])).alias("_m"))
    rows = found.select("_blob", "_m.*").repartition(partitions(versions), "_blob").dropDuplicates(["_blob", "kind_no", "at"])  # repeated rows are one text
    order = Window.partitionBy("_blob", "kind_no").orderBy("at")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    good = F.coalesce(F.col("good"), F.lit(False))
    before = Window.partitionBy("_blob").orderBy(~good, "start", "kind_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("clear", F.greatest(F.lit(0), F.coalesce(F.max("end").over(before), F.lit(0))))
    kind = F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), F.col("kind_no") + 1)
    span = F.when(good, F.struct("start", "kind_no", "end", kind.alias("kind"), "clear").cast(SPAN))
    return placed.groupBy("_blob").agg(F.sort_array(F.collect_list(span)).alias("spans")).select(F.col("_blob").alias("blob"), F.lit(RULES_VERSION).alias("rules"), "spans")


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/spotlattice/ledger-{uuid.uuid4().hex}.parquet"


def update(versions: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger at ``path`` after the blobs it did not hold have been scanned and appended to it."""
    spark = versions.sparkSession
    spark.range(0).selectExpr("CAST(NULL AS BINARY) AS blob", "CAST(NULL AS STRING) AS rules", f"CAST(NULL AS ARRAY<{SPAN}>) AS spans").write.mode("ignore").parquet(path)
    known = spark.read.schema(LEDGER).parquet(path)
    scan_unseen(versions, known, id_col, text_col).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _hits(ledger: DataFrame) -> DataFrame:
    """(_blob, spans) of the blobs with findings."""
    return ledger.where(F.col("rules") == RULES_VERSION).where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), "spans")


def scan(versions: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _blob, spans) for every version: the findings of the completed ledger, joined to all paths.

    Both sides of the join come from tables, so AQE splits the partition of a hot blob.
    """
    ledger = update(versions, path or new_ledger(versions.sparkSession), id_col, text_col)
    paths = _addressed(versions, id_col, text_col).select("_id", "_blob")
    return paths.join(_hits(ledger).hint("shuffle_hash"), "_blob", "left").select("_id", "_blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("_id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that is cut into blocks."""
    i, j = (F.floor(x / BLOCK).cast("int") for x in (start, end))
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    one = block(i).substr(start - i * BLOCK + 1, end - start)
    many = F.concat(block(i).substr(start - i * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), block(j).substr(F.lit(1), end - j * BLOCK))
    return F.when(start >= end, "").when(i == j, one).otherwise(many)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """docs with the same columns, each span of the text replaced by ``mark``; spans that overlap share one.

    Spans are those of the completed ledger: a blob is scanned once unless the ledger has it, and joined back to every row
    that holds it.  A text is cut into blocks first, so the work is linear in it however many spans it has.
    """
    text, spans, blocks = F.col(text_col), F.col("_spans"), F.col("_blocks")
    ledger = update(docs, path or new_ledger(docs.sparkSession), id_col, text_col)
    keyed = docs.withColumn("_blob", F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)))
    met = keyed.join(_hits(ledger).withColumnRenamed("spans", "_spans").hint("shuffle_hash"), "_blob", "left")
    cut = met.withColumn("_blocks", F.when(spans.isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    pieces = F.transform(spans, lambda s: F.when(s["start"] >= s["clear"], F.concat(_between(blocks, s["clear"], s["start"]), F.lit(mark))).otherwise(""))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    clean = F.concat(F.array_join(pieces, ""), _between(blocks, last, F.length(text)))
    return cut.select(*[F.when(spans.isNotNull(), clean).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])


#: Spans by the lengths of gaps and matches, kind by kind.
SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    + ", ".join(
        f"m{n} AS (SELECT doc_id, k, {n} AS kind_no, '{kind}' AS kind, length(g[k]) AS gap, m[k] AS m FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, unnest(generate_series(1, len(regexp_extract_all(t, '{p}', 0)))) AS k FROM d))"
        for n, (kind, pattern, _) in enumerate(RULES)
        for p in [pattern.replace("'", "''")]
    )
    + ", p AS (SELECT *, sum(gap + length(m)) OVER (PARTITION BY doc_id, kind_no ORDER BY k) AS e FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2)), "
    + "s AS (SELECT doc_id, kind, kind_no, CAST(e - length(m) AS BIGINT) AS a, CAST(e AS BIGINT) AS e FROM p WHERE kind_no > 0 OR length(regexp_extract(m, '" + ASSIGN.replace("'", "''") + "', 2)) >= 6), "
    + "f AS (SELECT doc_id, count(*) FILTER (WHERE kind_no = 0) AS n_assign, count(*) FILTER (WHERE kind_no = 1) AS n_access, count(*) FILTER (WHERE kind_no = 2) AS n_hex, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, kind_no) AS spans FROM s GROUP BY doc_id) "
    + "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"
)
