"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. Its ratio target / size splits
into whole copies, which every document gets for certain, and a remaining
inclusion probability. For the remainder documents are ranked by their random
odds divided by their inclusion odds and taken from the top until the
source's words meet its target: the sample has a fixed size in words, and the
inclusion probabilities differ between sources.

The cut in the ranking is found without sorting a source in one task: words
are summed per (source, bin of the rank), a running sum over the bins finds
the bin in which the target falls, and only that bin is ranked row by row.

Defined results for odd input: a null text has size 0; a null source is a
source of its own and comes last; documents of size 0 take 0 words; rows with
the same id share their random number and are told apart by size; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed, table, text_or_empty, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix against the words of all sources.
SHARE = 1.5
#: No document is taken more often than this.
MOST_COPIES = 2
#: Bins of the rank: a source's running sum has so many rows at most, and its cut is sought in 1 / BINS of its documents.
BINS = 4096
SEED = "mix-1"
#: Tables by source are broadcast up to so many rows (about 10 MB) and shuffled beyond.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source`` and ``size``.

    Sharing the excess of capped sources again and again ends at the one level
    at which every source has the smaller of its cap and weight x level. In
    ascending order of cap / weight the capped sources come first, so running
    sums give that level. The frame has one row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    every = Window.partitionBy()
    ranked = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    cap = (F.col("source_size") * most).cast("double")
    per = (
        per.withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("source_size").over(before) * most, F.lit(0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", cap * F.col("rest") <= F.col("weight") * F.col("left"))
    )
    # the first source below its cap has the most weight left
    level = F.max(F.when(~F.col("capped"), F.struct("rest", "left"))).over(every)
    return per.select("source", "source_size", F.when(F.col("capped"), cap).otherwise(F.col("weight") * level["left"] / level["rest"]).alias("target"))


def _small(per_source: DataFrame) -> DataFrame:
    """A table with a row per source, written once; it goes to every task if it is counted to be short."""
    rows = checkpointed(per_source)
    return F.broadcast(rows) if rows.count() <= BROADCAST_SOURCES else rows


def uniform(id_col: str, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(16**12))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` reduced to the id, ``keep`` columns (prefixed ``in_``), ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    A document's copies x size are the words the mix takes of it. The cut goes
    where a source's words come nearest to its target, so it misses the target
    by half a document at most.
    """
    keep = keep or []
    rows = checkpointed(
        docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(text_or_empty(text)).alias("size"), *[F.col(f"`{c}`").alias(f"in_{c}") for c in keep])
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = _small(
        source_targets(rows)
        .withColumn("whole", F.floor(ratio))
        .withColumn("inclusion", ratio - F.floor(ratio))
        .withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    u = uniform("id", seed)
    odds = (u / (F.lit(1.0) - u)) / (F.col("inclusion") / (F.lit(1.0) - F.col("inclusion")))
    # the rank itself has no bounds; rank / (1 + rank) falls into (0, 1) in the same order
    ranked = (
        rows.join(targets, rows["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("rank", F.when(F.col("inclusion") > 0, odds))
        .withColumn("bin", F.floor(F.col("rank") / (F.lit(1.0) + F.col("rank")) * BINS))
    )
    bins = ranked.filter("rank IS NOT NULL").groupBy("source", "bin", "wanted").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # the last bin that starts below the target holds the cut
    cut = (
        bins.withColumn("below", F.sum("words").over(upto) - F.col("words"))
        .filter("below < wanted")
        .groupBy("source")
        .agg(F.max_by(F.struct("bin", "below"), "bin").alias("at"))
        .select(F.col("source").alias("cut_source"), F.col("at.bin").alias("cut_bin"), F.col("at.below").alias("cut_below"))
    )
    marked = ranked.join(_small(cut), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    at_cut = F.col("bin") == F.col("cut_bin")
    in_order = Window.partitionBy("source", "bin").orderBy("rank", "id", "size")
    inside = (
        marked.filter(at_cut)
        .withColumn("reached", F.col("cut_below") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        # the document that straddles the target stays if that brings the words nearer
        .withColumn("extra", (F.col("reached") - F.col("wanted") <= F.col("wanted") - (F.col("reached") - F.col("size"))).cast("long"))
        .drop("reached")
    )
    outside = marked.filter(at_cut.isNull() | ~at_cut).withColumn("extra", F.coalesce((F.col("bin") < F.col("cut_bin")).cast("long"), F.lit(0).cast("long")))
    copies = F.col("whole") + F.col("extra")
    return outside.unionByName(inside).select(
        F.col("id").alias(id_col),
        *[F.col(f"in_{c}") for c in keep],
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Rows that agree in id, source and text are told apart by number only: so
    many of them as the sample took get the additional copy.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    keys = {"__id": F.col(id_col), "__source": F.col(source), "__body": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    rows = mix(docs.select("*", keys["__body"].alias("__body")), id_col, text, source, ["__body", source], seed)
    per = rows.groupBy(F.col(id_col).alias("__id"), F.col(f"in_{source}").alias("__source"), F.col("in___body").alias("__body")).agg(
        F.first("size").alias("__size"),
        F.first("source_size").alias("__source_size"),
        F.first("target").alias("__target"),
        F.min("copies").alias("__least"),
        (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("__more"),
    )
    per = per.filter("__least + __more > 0")
    same = [keys[k].eqNullSafe(F.col(k)) for k in keys]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__id"))
    joined = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).join(per, same[0] & same[1] & same[2])
    copies = F.col("__least") + (nth <= F.col("__more")).cast("long")
    out = joined.withColumn("copies", copies).filter("copies > 0")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in added],
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        "copies",
        (F.col("copies") * F.col("__size")).alias("taken"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(source_size) OVER before * {MOST_COPIES}, 0) AS remain,
             sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest FROM s
      WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, {MOST_COPIES} * source_size * rest <= w * remain AS capped FROM o),
t AS (SELECT source, source_size,
             CASE WHEN capped THEN CAST({MOST_COPIES} * source_size AS DOUBLE)
                  ELSE w * (SELECT max_by(remain, rest) FROM c WHERE NOT capped) / (SELECT max(rest) FROM c WHERE NOT capped) END AS target FROM c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio FROM t),
q AS (SELECT d.doc_id, d.source, d.size, source_size, target, floor(ratio) AS whole, ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS wanted,
             (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {16**12}::DOUBLE AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rk FROM q),
z AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rk, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached FROM k)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN rk IS NOT NULL AND reached - wanted <= wanted - (reached - size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM z
"""
