"""The corpus pipeline: language ID, exact de-duplication, near-duplicates, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; :func:`run`
writes every stage as Parquet into the shared folder and the next stage reads
that table. A run that loses executors repeats at most the stage it is in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leagueflow.llm import decontaminate, exact_dedup, langid, mixing, simhash
from leagueflow.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which language ID recognises a language."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.keep_one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents' columns, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    return mixing.mixture(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_neardup", near), ("decontaminate", clean), ("mix_sources", mix)]

#: Language ID has no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
