"""A corpus from documents to token ids in five stages, each an operator of ``threadspark.llm``.

All stages take a null text as an empty one, judge repeated rows each by itself unless stated, leave extra columns of any
name alone, and make an empty table of an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadspark.llm import decontaminate, exact, ngrams, sentences, toxicity
from threadspark.llm.common import stored, table
from threadspark.llm.queries import PIECES


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; ids play no part."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; a null id is the smallest, and of rows that repeat id and text one stays."""
    return exact.drop_copies(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (5-word shingles, similarity 0.8 or more) the smallest doc_id; empty texts and rows without an id stay."""
    return ngrams.drop_near_copies(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows; those without words stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, a row per row, null ids included."""
    return sentences.token_digests(docs, PIECES)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

#: Boosted trees and merge tables have no SQL form; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
