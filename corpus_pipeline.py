"""From raw documents to token ids: language, line dedup, near duplicates, decontamination, BPE.

Every stage takes all rows its predecessor kept, and every stage but the last returns the columns of `documents`.

Defined cases: a null, empty or letterless text is of no known language, so its row goes in the first stage; a null
doc_id is in no group of copies and no decision depends on it; of rows with the same doc_id and text one stays, of two
texts of one doc_id only the copied one goes; other columns are carried along, whatever their names are; an empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import bpe, decontam, langid, linedup, ngramjoin
from answerloom.llm.common import table
from answerloom.session import settle

LEAST_LANGUAGE_SCORE = 0.2
NEAR_WORDS, NEAR_PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is one of those learnt from the labelled rows; `und` and weak scores go."""
    return langid.accepted(docs, langid.train(docs), LEAST_LANGUAGE_SCORE)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs from the texts and bring n_chars up to date; no document goes."""
    shorter = linedup.dedup_lines(docs, removed=None)
    return shorter.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group, of its smallest doc_id; documents without words, or without doc_id, are in no group."""
    return ngramjoin.one_of_each_group(docs, NEAR_WORDS, NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", token_ids),
]

ORACLE_SQL = None  # a trained model and a graph's components; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
