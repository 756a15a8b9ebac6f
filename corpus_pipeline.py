"""A corpus pipeline: documents through five operators, each stage on all that its predecessor kept.

Rows of the result are the encoded documents of the mixture; empty tables pass through all stages. Exact and near duplicates, hashes and piece ids are not
SQL, so there is no ORACLE_SQL; tests/llm/test_pipeline.py compares the stages with brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import jaccard_join, language, mixing, piece_codec, trie_dedup
from framelake.llm.common import saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text or letters, or without a likely language, go (see language.accept)."""
    return language.accept(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (up to white space; null as empty), the one with the smallest id, null ids last; of repeated rows one."""
    return trie_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of five-word shingles and a similarity of 0.8 or more, the one with the smallest id, null ids
    last. Documents without words link with nothing and all stay."""
    return jaccard_join.representatives(docs, k=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, at most three times; null is a source, and null texts have no size."""
    return mixing.mixture(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document (none of an empty or null text), and whether they decode to its text; repeated rows each get a row."""
    done = piece_codec.encode(docs, verify=True)
    return done.select("doc_id", "n_chunks", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what passes from one to the next is written once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
