"""Explainable expected points per (player, upcoming period).

The whole job is one lazy plan: a bounded list of upcoming periods, a per-team
difficulty lookup, the rolling form view and one projection of the formula.
Expected minutes do not depend on the period, so they are computed once per
player before the (player × period) expansion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leagueflow.functions.casts import round2
from leagueflow.functions.scoring import (
    NEUTRAL_DIFFICULTY,
    difficulty_multiplier,
    expected_minutes,
    point_components,
)
from leagueflow.operators.marts import not_finished
from leagueflow.session import maybe_broadcast

OUTPUT_COLUMNS = ["player_id", "event_id", "xmins", "xpts", "xpts_att", "xpts_def", "xpts_app"]


def next_periods(upcoming: DataFrame, horizon: int, period: str = "event_id") -> DataFrame:
    """The next ``horizon`` distinct periods that still have an upcoming fixture, ascending.

    The limit is the feature (a top-k); its output has at most ``horizon`` rows.
    """
    return (
        upcoming.where(F.col(period).isNotNull())
        .select(F.col(period).alias("event_id"))
        .distinct()
        .orderBy("event_id")
        .limit(horizon)
    )


def side_lookup(
    upcoming: DataFrame,
    period: str = "event_id",
    fixture_id: str = "id",
    home: str = "team_h",
    away: str = "team_a",
    home_difficulty: str = "team_h_difficulty",
    away_difficulty: str = "team_a_difficulty",
) -> DataFrame:
    """(team_id, event_id) → difficulty, is_home, opponent of that team's fixture.

    Each fixture is un-pivoted into a home row and an away row in one pass
    (``inline`` of a two-element array, no union re-scan). When a team has
    several fixtures in one period, one survives deterministically: the highest
    fixture id, away after home. It is an aggregate with map-side partial
    ``max_by``, so a hot (team, period) never gathers its rows in one task.
    """
    f = upcoming.where(F.col(period).isNotNull() & F.col(home).isNotNull() & F.col(away).isNotNull())
    sides = f.select(
        F.col(period).alias("event_id"),
        F.inline(
            F.array(
                F.struct(
                    F.col(home).alias("team_id"),
                    F.col(fixture_id).alias("fixture_id"),
                    F.lit(0).alias("side"),
                    F.coalesce(F.col(home_difficulty), F.lit(NEUTRAL_DIFFICULTY)).alias("difficulty"),
                    F.col(home).alias("team_h"),
                    F.col(away).alias("team_a"),
                ),
                F.struct(
                    F.col(away).alias("team_id"),
                    F.col(fixture_id).alias("fixture_id"),
                    F.lit(1).alias("side"),
                    F.coalesce(F.col(away_difficulty), F.lit(NEUTRAL_DIFFICULTY)).alias("difficulty"),
                    F.col(home).alias("team_h"),
                    F.col(away).alias("team_a"),
                ),
            )
        ),
    )
    picked = sides.groupBy("team_id", "event_id").agg(
        F.max_by(
            F.struct("difficulty", "team_h", "team_a", "side", "fixture_id"),
            F.struct("fixture_id", "side"),
        ).alias("w")
    )
    return picked.select(
        "team_id",
        "event_id",
        F.col("w.difficulty").cast("int").alias("difficulty"),
        (F.col("w.side") == 0).alias("is_home"),
        F.when(F.col("w.side") == 0, F.col("w.team_a")).otherwise(F.col("w.team_h")).alias("opponent_team"),
    )


def finished_period_count(events: DataFrame, finished: str = "finished") -> DataFrame:
    """One row: number of finished periods."""
    return events.agg(F.count_if(F.coalesce(F.col(finished), F.lit(False))).alias("finished_events"))


def attach_periods(
    players: DataFrame,
    upcoming: DataFrame,
    events: DataFrame,
    horizon: int,
) -> DataFrame:
    """Players with a team, each carrying the array of the next ``horizon``
    periods (``_periods``) and the finished-period count.

    Both are one-row aggregates used as scalar subqueries (computed once,
    shipped as values; the period array has at most ``horizon`` elements), so
    exploding ``_periods`` later builds the (player × period) grid without
    any join.
    """
    periods = next_periods(upcoming, horizon).agg(F.sort_array(F.collect_list("event_id")).alias("_periods"))
    return (
        players.where(F.col("team_id").isNotNull())
        .withColumn("_periods", periods.scalar())
        .withColumn("finished_events", finished_period_count(events).scalar())
    )


def baseline_scores(
    players: DataFrame,
    form: DataFrame,
    fixtures: DataFrame,
    events: DataFrame,
    horizon: int = 3,
    n: int = 5,
    computed_at: str | None = None,
) -> DataFrame:
    """Expected points per (player, period) for the next ``horizon`` periods.

    ``players``: id, team_id, element_type_id, minutes, points_per_game, status.
    ``form``: output of :func:`leagueflow.operators.marts.last_n_form`.
    ``fixtures``: silver fixtures; only unfinished (or unknown) ones are used.
    A period without a fixture for the team scores at neutral difficulty; a
    double period is not summed (one fixture's difficulty is used).
    """
    g, m, pts = f"games_last{n}", f"minutes_last{n}", f"points_last{n}"
    upcoming = fixtures.where(not_finished())
    p = players.select(
        F.col("id").alias("player_id"), "team_id", "element_type_id", "minutes", "points_per_game", "status"
    )
    fm = form.select(F.col("player_id").alias("_fp"), g, m, pts)
    per_player = p.join(fm, p["player_id"] == fm["_fp"], "left").drop("_fp")
    per_player = attach_periods(per_player, upcoming, events, horizon)
    # Loop-invariant: expected minutes once per player, before the period expansion.
    per_player = per_player.withColumn("_xmins", expected_minutes(g, m, "minutes", "finished_events", "status"))
    grid = per_player.withColumn("event_id", F.explode("_periods")).drop("_periods")
    lookup = side_lookup(upcoming).select("team_id", "event_id", "difficulty")
    # Only the scored periods matter: after the semi-join the lookup has at most
    # (teams × horizon) rows; it is broadcast only behind the size check.
    lookup = lookup.join(F.broadcast(next_periods(upcoming, horizon)), "event_id", "left_semi")
    scored = grid.join(maybe_broadcast(lookup), ["team_id", "event_id"], "left")
    mult = difficulty_multiplier(F.coalesce(F.col("difficulty"), F.lit(NEUTRAL_DIFFICULTY)))
    comp = point_components("_xmins", m, pts, "points_per_game", "element_type_id", mult)
    out = scored.select(
        "player_id",
        "event_id",
        round2("_xmins").alias("xmins"),
        round2(comp["xpts"]).alias("xpts"),
        round2(comp["xpts_att"]).alias("xpts_att"),
        round2(comp["xpts_def"]).alias("xpts_def"),
        round2(comp["xpts_app"]).alias("xpts_app"),
    )
    if computed_at is not None:
        out = out.withColumn("computed_at_utc", F.lit(computed_at).cast("timestamp_ntz"))
    return out


def top_scores(scores: DataFrame, k: int = 10, period: str = "event_id") -> DataFrame:
    """Top ``k`` rows of the earliest period in ``scores`` by xpts desc, player id asc."""
    first = scores.agg(F.min(period)).scalar()
    return scores.where(F.col(period) == first).orderBy(F.col("xpts").desc(), F.col("player_id").asc()).limit(k)
