"""Which entities need refreshing, from the table of last fetches.

One row per key, kept beside the ingestion log (or aggregated from the log
where there is no such table), one left join to the candidates and one boolean
column: no driver-side sets, and the clock (``as_of``) is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leagueflow.functions.keys import key_id


def top_candidates(players: DataFrame, n: int | None, by: str = "total_points", id_col: str = "id") -> DataFrame:
    """Candidates with a rank: top ``n`` by ``by`` desc (NULLs last, ties by id) or all by id.

    The limit is the feature here (a top-n refresh mode).
    """
    if n is None:
        # every candidate; candidate order is id order, so the id is the rank
        return players.select(F.col(id_col).alias("player_id"), F.col(id_col).cast("bigint").alias("rank"))
    order = [F.col(by).desc_nulls_last(), F.col(id_col).asc()]
    top = players.orderBy(*order).limit(n)  # bounded by n: the ranking window runs on n rows
    return top.select(F.col(id_col).alias("player_id"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"))


def last_fetch(log: DataFrame, prefix: str = "element-summary:") -> DataFrame:
    """(player_id, last_fetched) of the keys that have the prefix and a valid id.

    ``log`` is the table of last fetches, one row per key, or the ingestion log
    itself. Keys that name the same id in other ways meet in the aggregate.
    """
    when = "last_fetched" if "last_fetched" in log.columns else "fetched_at_utc"
    return (
        log.where(F.col("request_key").startswith(prefix))
        .select(key_id("request_key", prefix).alias("player_id"), F.col(when).alias("_when"))
        .where(F.col("player_id").isNotNull())
        .groupBy("player_id")
        .agg(F.max("_when").alias("last_fetched"))
    )


def _cutoff(as_of: str, hours: float):
    ts = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(round(hours * 3600, 6)).cast("decimal(18,6)")
    )
    return F.date_trunc("second", ts).cast("timestamp_ntz")


def select_incremental(
    candidates: DataFrame,
    log: DataFrame,
    as_of: str,
    since_hours: float | None = None,
    max_age_hours: float | None = None,
    force: bool = False,
) -> DataFrame:
    """Candidates to fetch, in candidate order (``player_id, rank``).

    ``force`` or no ``since_hours`` → every candidate. Else a candidate is
    fetched when never fetched, last fetched before ``as_of - since_hours``,
    or (``max_age_hours`` set) before ``as_of - max_age_hours``. Cutoffs are
    truncated to the second; option values ≤ 0 count as unset.
    """
    since = since_hours if since_hours is not None and since_hours > 0 else None
    max_age = max_age_hours if max_age_hours is not None and max_age_hours > 0 else None
    if force or since is None:
        return candidates.select("player_id", "rank")
    lf = last_fetch(log)
    j = candidates.join(lf, "player_id", "left")
    due = F.col("last_fetched").isNull() | (F.col("last_fetched") < _cutoff(as_of, since))
    if max_age is not None:
        due = due | (F.col("last_fetched") < _cutoff(as_of, max_age))
    return j.where(due).select("player_id", "rank")
