"""A corpus pipeline of five of the operators: each stage takes the documents that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir).  All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty one; columns beyond the id and the text are carried, whatever
their names; a null or empty text is a text without words, lines and secrets, and rows without an id stand for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spotlattice.llm import line_dedup, ngram_join, packing, quality_classifier, secret_scan
from spotlattice.llm.common import shared_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  Repeated rows are judged each; a score at the threshold stays."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the one of the smallest id only.  A document that loses all lines stays, empty."""
    return line_dedup.dedup_texts(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more.

    Ties go to the smallest id, all rows of which stay; documents without words are no one's copy.
    """
    return ngram_join.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; no document goes.  Repeated texts are scanned once; spans that overlap leave one mark."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences.  A document without text is its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", unique_lines),
    ("ngram_jaccard_join", one_of_near_copies),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: The classifier and the tokenizer are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's documents are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = shared_table(docs)
    return docs
