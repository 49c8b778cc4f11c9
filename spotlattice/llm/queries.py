"""The corpus queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, embedding_dedup, language_id, line_dedup, ngram_join, packing, quality_classifier, quality_rules, secret_scan, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(function: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(*[_table(spark, sf_dir, t) for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": _over(line_dedup.query, "documents"),
    "op2_secret_scans": _over(secret_scan.query, "documents"),
    "op3_token_counts": _over(token_count.query, "documents"),
    "op4_language_id": _over(language_id.query, "pages", "documents"),
    "op5_ngram_jaccard_join": _over(ngram_join.query, "documents"),
    "op6_best_fit_packing": _over(packing.query, "documents"),
    "op7_quality_rules": _over(quality_rules.query, "documents", "labels"),
    "op8_embedding_near_dedup": _over(embedding_dedup.query, "embeddings"),
    "op9_byte_level_bpe": _over(bpe_codec.query, "documents"),
    "op10_quality_classifier": _over(quality_classifier.query, "documents", "labels"),
}
SQL: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op2_secret_scans": secret_scan.SQL, "op5_ngram_jaccard_join": ngram_join.SQL, "op8_embedding_near_dedup": embedding_dedup.SQL}
