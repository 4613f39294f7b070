"""A corpus from raw documents: language, near-duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; its result is written as
Parquet and read again as the documents of the next. SQL can express no stage as a whole (trained
models, fingerprints by XXH64, schedules), so ORACLE_SQL is None and tests compare with plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scaleloom.llm import benchmark_leaks, language_id, mixing, pii, simhash_dedup
from scaleloom.llm.common import clear, stash, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told; labels become the predictions."""
    return language_id.drop_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash_dedup.keep_one_similar(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return benchmark_leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in an order in which sources keep their weights; adds mix_phase, mix_slot, mix_position."""
    return mixing.arranged(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_personal_data", mask_personal_data),
    ("mix_sources", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages. A stage's intermediate tables go when its result is written."""
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        clear(spark, since, [docs])
    return STAGES[-1][1](spark, docs, sf_dir)
