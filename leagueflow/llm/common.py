"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.session import ensure_checkpoint_dir

#: ASCII white space as the contracts define it; everything else is part of a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of the text as a long."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names, so that later stages do not recompute ``df``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def repeat_rows(df: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times with its number in ``occurrence`` (from 0).

    Two nested ranges keep the generated arrays small however often a row
    repeats.
    """
    step = 4096
    outer = F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / step).cast("long")))
    first = F.col("__chunk") * step
    inner = F.explode(F.sequence(first, F.least(first + step, F.col(n)) - 1))
    return df.withColumn("__chunk", outer).withColumn("occurrence", inner).drop("__chunk")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: like a checkpoint, but columns can be left unread."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def query_blocks(queries: DataFrame, key: str, size: Column, most_rows: int, most_bytes: int) -> Iterator[DataFrame]:
    """The rows of a stated query set in blocks that each fit a task and the driver.

    ``queries`` is a written table with a unique ``key``; ``size`` is a row's
    bytes. Blocks are as many as the counted rows and bytes need, by the hash
    of the key, so that each has about its share.
    """
    n, total = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(-(-n // most_rows), -(-total // most_bytes))
    for k in range(blocks):
        yield queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == k) if blocks > 1 else queries
