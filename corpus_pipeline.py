"""The corpus pipeline: documents go through five of the corpus operators; each stage works on all that the one before kept.

Every stage but the last returns the columns of its docs as they are, whatever their names and types; doc_id may be of any
type with an order. Null texts count as empty and go with the first stage, as they have no language. Rows that repeat an
id and a text are one document after the second stage. Very long texts are worked on whole, a few at a time in a task. An
empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import bpe, decontaminate, exact_dedup, language, near_copies
from schemaloom.llm._common import table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: no letters, or unlike all languages that the labels teach."""
    return language.with_known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; a null id only where all are null."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a five-word Jaccard similarity of 0.8 or more the document with the smallest doc_id stays.

    A null id comes last, equal ids are told apart by the texts' digests.
    """
    return near_copies.without_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go: 0.8 or more of its five-word shingles. Without items all stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what remains: a row for each document."""
    return bpe.encoded(docs, bpe.FEW_WORDS)


STAGES = [("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("encode", encoding_stage)]

#: SQL expresses neither the language model nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
