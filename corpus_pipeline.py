"""Corpus pipeline: from raw documents to tokens, each stage on all that the one before it kept.

STAGES names the stages and their functions of (spark, docs, sf_dir); run() applies them to the
documents table, writing what each returns to the shared folder. Every stage takes tables with nulls in
any column, empty and very long texts, repeated rows and further columns of any name, and gives an empty
table for an empty one; their docstrings say what becomes of such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import mixing, neardup, pieces, quality, substring
from skylattice.llm.common import stored, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels table. A null or empty text has the score of the bias."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8. Texts without words all stay, of repeated rows one does."""
    return neardup.deduplicated(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that start earlier in the corpus; a null doc_id comes last. A row that loses its last word goes, one without words stays."""
    return substring.without_substrings(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; null sources are one source, and texts without words are taken in whole epochs only."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids and n_pieces of every text, and whether decoding them gives the text again; a null text has no ids. Columns with these names are replaced."""
    return pieces.encoded(docs, checked=True)


STAGES = [
    ("quality classifier", accept_quality),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("source mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
