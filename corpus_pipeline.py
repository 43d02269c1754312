"""A corpus pipeline: language ID, exact dedup, near-duplicate dedup, mixing and SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet into
the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxspark.llm import exact_dedup, language_id, mixing, ngram_jaccard, sentencepiece_nbest
from boxspark.llm.common import stage, table
from boxspark.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, with the predicted one in ``lang``. Null and empty texts, texts without a
    letter and texts near to no language are rejected; null ids, repeated rows and null languages are ordinary rows."""
    return language_id.with_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the smallest id; a null text is an empty one. Rows that repeat that id
    stay with it; null ids stay only where a group has no other."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles, similarity 0.8 or more, hold together: the smallest
    id. Texts without words link with nothing and stay; a null id stays only where its group has no other."""
    return ngram_jaccard.one_of_each(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in whole takes; texts without words are not taken, a null
    source is a source, rows that repeat an id are taken alike."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The N best segmentations of each document, as digests, a row a row; a null text is an empty one."""
    return sentencepiece_nbest.digests(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixture), ("SentencePiece", pieces)]

#: Learned profiles, similarity joins and the piece lattice have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
