"""The corpus pipeline: each stage is one operator, written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewash.llm import decontaminate, line_dedup, packing, quality, simhash
from tidewash.llm.shared import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the quality classifier rejects go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: later occurrences of three-line passages go; the documents stay."""
    return line_dedup.without_repeats(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of documents that share 0.8 of their five-word shingles one stays.

    The operator's fingerprints, keys and pivots find the first pairs and the exact check unites
    them. No 64-bit fingerprint proves that share, so the operator's exact filter on rare shingles
    finds the pairs that are still apart; each is verified too.
    """
    return simhash.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the pieces of the documents that are left, each with its sequence and place."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", deduplicate_lines),
    ("simhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack),
]

#: The trained classifier, the fingerprints and the tokenizer have no SQL; tests/llm checks each stage by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
