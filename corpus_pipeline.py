"""A training-data pipeline over ``documents``: five stages, each an operator.

1. quality: rows that the nearest-neighbour classifier rejects go;
2. lines: passages that an earlier document has are cut from the later ones;
3. near-duplicates: one document of each SimHash component stays;
4. decontamination: documents that hold a benchmark item go;
5. mixing: the rest is interleaved to target weights, as ``mix_position`` tells.

A stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``docs``; the
last one adds its own. Rows with NULLs pass as the operators' docstrings say; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledger_spark.llm import decontaminate, linededup, mixing, quality, simhash
from ledger_spark.llm.catalog import shipped
from ledger_spark.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, sf_dir)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_repeats(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, sf_dir)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [(name, shipped(stage)) for name, stage in (
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
)]

#: Learning, alignment and Hamming search cannot be said in SQL; tests/llm holds
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents. Each stage's rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
