"""Exact de-duplication by progressive refinement.

Three keys, each finer and dearer than the one before: the text's length in
bytes, a hash of its first bytes, and SHA-256 of the whole text. A document
whose length (then prefix) nobody shares leaves the search at that step, so
the whole-text groups are formed among the survivors only. Where the digest of
every text is part of the result all keys come from one scan, and what follows
moves keys of a few dozen bytes, never the texts; where only the rows that stay
are asked for, whole texts are hashed and grouped for survivors alone.

Defined results for odd input: a null text counts as empty; a null ``doc_id``
never wins against a number; rows repeated with the same ``doc_id`` and text
are one group in which exactly one row stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed, repeat_rows, table, text_or_empty

#: Characters of the text that the second key reads.
PREFIX_CHARS = 256


def refinement_keys(docs: DataFrame, text: str = "text") -> list:
    """The three keys, cheapest first."""
    t = text_or_empty(text)
    return [
        F.octet_length(t).alias("length_key"),
        F.xxhash64(F.substring(t, 1, PREFIX_CHARS)).alias("prefix_key"),
        F.sha2(t.cast("binary"), 256).alias("text_sha256"),
    ]


def duplicate_groups(keyed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Groups of two or more equal texts: the keys, ``keep_id`` and ``group_size``.

    ``keyed`` has the id, the three keys and ``n`` (how often the row occurs).
    The refinement works on counts per key, not on rows: a length (then a
    prefix) that several rows share survives to the next, finer key. So a hot
    key is one row with a count, summed before its shuffle, in every step.
    """
    lengths = keyed.groupBy("length_key").agg(F.sum("n").alias("members")).filter("members > 1").select("length_key")
    prefixes = keyed.groupBy("length_key", "prefix_key").agg(F.sum("n").alias("members")).filter("members > 1")
    prefixes = prefixes.join(lengths, "length_key", "left_semi").select("length_key", "prefix_key")
    texts = keyed.groupBy("length_key", "prefix_key", "text_sha256").agg(F.max(id_col).alias("keep_id"), F.sum("n").alias("group_size"))
    return texts.join(prefixes, ["length_key", "prefix_key"], "left_semi").filter("group_size > 1")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The row with the largest id of a group stays. The digest of every text is
    part of the result, so it is taken in the one scan that also makes the
    cheaper keys; the keys are checkpointed, and so are the groups, so that the
    join back to the rows can split a group that a third of them belong to.
    """
    keyed = docs.select(F.col(id_col), *refinement_keys(docs, text))
    keys = ["length_key", "prefix_key", "text_sha256"]
    rows = checkpointed(keyed.groupBy(id_col, *keys).agg(F.count(F.lit(1)).alias("n")))
    groups = checkpointed(duplicate_groups(rows, id_col))
    joined = rows.join(groups, keys, "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return repeat_rows(joined, "n").select(
        F.col(id_col),
        keep.alias("keep_id"),
        size.alias("group_size"),
        (F.col(id_col).eqNullSafe(keep) & (F.col("occurrence") == 0)).alias("kept"),
        "text_sha256",
    )


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that two or more rows have, counted before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select(*keys)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Of equal texts the row with the largest id stays; ties on the id go to the
    largest of the remaining columns in their order, so reruns agree. Lengths
    are counted, then prefix hashes among the shared lengths. Rows
    that share both are hashed and grouped as a whole, copies meeting in the
    partial aggregate; the others stay without more ado. The joins meet written
    keys, so they can split a length or prefix that a third of the rows have.
    """
    others = [c for c in docs.columns if c not in (id_col, text)]
    fields = [F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text}`").alias("t")]
    length, prefix, _ = refinement_keys(docs, text)
    lengths = _counted(docs.select(length), "length_key")
    # counts per key meet the lengths, not rows: a hot length is a few counts by then
    prefixes = checkpointed(_counted(docs.select(length, prefix), "length_key", "prefix_key").join(lengths, "length_key", "left_semi"))
    row = docs.select(F.struct(*fields).alias("row"), length, prefix)
    met = row.join(prefixes.withColumn("shared", F.lit(True)), ["length_key", "prefix_key"], "left")
    alone = met.filter("shared IS NULL").select("row")
    whole = F.sha2(text_or_empty("row.t").cast("binary"), 256).alias("text_sha256")
    grouped = met.filter("shared").groupBy("length_key", "prefix_key", whole).agg(F.max("row").alias("row")).select("row")
    back = {id_col: "row.id", text: "row.t"} | {c: f"row.c{i}" for i, c in enumerate(others)}
    return alone.unionAll(grouped).select(*[F.col(back[c]).alias(c) for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT doc_id, sha256(body) AS text_sha256,
             max(doc_id) OVER (PARTITION BY body) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size,
             row_number() OVER (PARTITION BY body, doc_id) AS nth FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND nth = 1) AS kept, text_sha256 FROM g
"""
