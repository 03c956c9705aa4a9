"""Connected components of an edge table, as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, written once: the join back on a node with very many edges can then be split."""
    return checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) from edges ``a``, ``b``.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to the smallest of its neighbourhood, then its smaller ones.
    The minimum of a neighbourhood is a partial aggregate, and the join back on
    the node can be split where a node has many edges. The number of rounds is
    about logarithmic in the length of a component; each is checkpointed. Nodes
    without an edge are not in the result.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = checkpointed(both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.join(_min_neighbour(large), "u")
        # one pass gives both kinds of new edges: the neighbour and the node itself, each to the smallest
        step = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = checkpointed(step.filter("u <> v").distinct())
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
