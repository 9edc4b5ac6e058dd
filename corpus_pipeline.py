"""A training-corpus pipeline: quality rules, near-duplicates, secrets, the mix of sources, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns of documents.

Defined cases: documents with null, empty or few words go in the first stage, as do all rows if there are none; a row with a null doc_id
is judged by its text and never counts as a copy; rows that repeat a doc_id stay or go together, are taken equally often, and each
occurrence has a segmentation of its own; texts are read whole; columns of any name, those that stages use inside too, are passed on
as they are, but for text, which the pieces replace, and n_chars, which follows changed texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentfield.llm import jaccard_join, mixing, piece_codec, quality, secret_scan
from latentfield.llm.common import documents, fresh, staged
from latentfield.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the trees reject go."""
    return quality.passing(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return jaccard_join.representatives(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return secret_scan.without_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks for."""
    return mixing.mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as piece ids, in place of text. Rows that repeat a document are numbered, and each has a segmentation of its own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id", *others)
    number = fresh(docs, "__occurrence")
    numbered = docs.withColumn(number, F.row_number().over(same))
    return piece_codec.with_pieces(numbered, tokenizer("piece_bpe_32k.model"), dropout=0.1, seed=1, occurrence=number)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: The trees and the piece merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
