"""Best-fit packing planned on the histogram of piece lengths; pieces then take planned slots by their rank within length.

The plan is best-fit decreasing over counts: for each length, longest first, as many bins of the smallest room that fits are
filled at once.  It depends on at most ``size`` counts, so the driver gets a bounded histogram whatever the corpus is.

Defined results: a null or empty text is one token (the end id); only documents above ``size`` tokens are cut, the first
piece taking the remainder; repeated rows are packed each; ties of rank fall to (id, piece, checksum); other columns are
not read.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_codec import Codec, packed
from .common import map_texts, shared_table

#: Tokens of a sequence; pieces that one task ranks, and the least number of parts of a length's pieces.
SIZE, RANKED, SALTS = 2048, 500_000, 64


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder(Codec):
    """Ids as the tokenizer file gives them: its special strings cut the text, the rest goes by the same vocabulary's ranks.

    Pre-tokens are encoded by the library that reads the ranks, since ids are only an input of packing.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        super().__init__(ranks_path)
        with open(json_path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.special = {t["content"]: packed([t["id"]]) for t in added}
        self.find = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def word(self, word: str) -> bytes:
        return packed(self.core.encode_ordinary(word)) if len(word) < 1000 else super().word(word)

    def ids(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            return super().ids(text)
        return b"".join([self.special[x] if k % 2 else super(Encoder, self).ids(x) for k, x in enumerate(self.find.split(text))])


@lru_cache(2)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def _pieces(paths: tuple[str, str], size: int, end_id: int):
    def run(batches):
        e, end = encoder(*paths), packed([end_id])
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(e.ids(text or "") + end)
                n = len(ids) // 4
                start, stop, k = 0, (n - 1) % size + 1, 0
                while start < n:
                    for column, x in zip(out, (i, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(x)
                    start, stop, k = stop, stop + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if j == 1 else pa.int64()) for j, x in enumerate(out)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, items of this length a bin, room used before) by best fit over counts."""
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free room: runs of bins (first, how many)
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = next((r for r in range(length, size) if rooms[r]), None)
            if room is None:
                room, each = size, size // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = rooms[room].pop()
                each = room // length
            take = min(n, left // each) or 1  # or one bin that takes the few that are left
            each = min(each, left)
            rows.append((length, rank, rank + take * each, first, each, size - room))
            rooms[room - each * length].append((first, take))
            if n > take:
                rooms[room].append((first + take, n - take))
            rank, left = rank + take * each, left - take * each
    return rows


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only (length, salt) counts and piece rows are shuffled, never texts.  Ranks within a length are taken in parts, as many
    as keep a part to RANKED pieces were all of one length, so that a length that a third of all pieces has is ranked by many
    tasks.  The driver gets one count a length; the plan, a few rows a length, is broadcast.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    pieces = shared_table(map_texts(texts, _pieces(paths or default_paths(), size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    salts = max(SALTS, -(-pieces.count() // RANKED))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    parts = shared_table(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    before = parts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, size), "length long, _lo long, _hi long, _first long, _each long, _used long")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("_row", F.row_number().over(within)).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_row") - 1 + F.col("_before"))
    slotted = ranked.alias("p").join(F.broadcast(slots.alias("s")), F.expr("p.length = s.length AND _rank >= _lo AND _rank < _hi"))
    return slotted.select(
        "doc_id", "piece", "start", "p.length", "ids_crc32",
        F.expr("_first + (_rank - _lo) div _each").alias("sequence_id"), F.expr("_used + ((_rank - _lo) % _each) * p.length").alias("offset"),
    )


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
