"""Analytics views (gold): denormalised players, upcoming fixtures, rolling
last-N form and expected points for the next period.

Each view is a function of DataFrames with column names as parameters, and
:func:`register_marts` publishes all four as temp views for SQL users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leagueflow.session import maybe_broadcast


def not_finished(finished_col: str = "finished"):
    """Unfinished or unknown: ``finished = false OR finished IS NULL``."""
    return ~F.coalesce(F.col(finished_col), F.lit(False))


def player_latest(players: DataFrame, teams: DataFrame, positions: DataFrame) -> DataFrame:
    """Players LEFT teams LEFT positions, with cost in millions."""
    p = players.alias("p")
    t = maybe_broadcast(teams).alias("t")
    e = maybe_broadcast(positions).alias("e")
    return (
        p.join(t, F.col("p.team_id") == F.col("t.id"), "left")
        .join(e, F.col("p.element_type_id") == F.col("e.id"), "left")
        .select(
            F.col("p.id"),
            F.col("p.web_name"),
            F.col("p.first_name"),
            F.col("p.second_name"),
            F.col("p.team_id"),
            F.col("t.name").alias("team_name"),
            F.col("t.short_name").alias("team_short_name"),
            F.col("p.element_type_id"),
            F.col("e.singular_name_short").alias("position_short"),
            F.col("e.singular_name").alias("position_name"),
            F.col("p.now_cost"),
            (F.col("p.now_cost").cast("double") / F.lit(10.0)).alias("now_cost_million"),
            F.col("p.status"),
            F.col("p.minutes"),
            F.col("p.total_points"),
            F.col("p.selected_by_percent"),
            F.col("p.form"),
            F.col("p.points_per_game"),
            F.col("p.expected_goals"),
            F.col("p.expected_assists"),
            F.col("p.ingested_at_utc"),
        )
    )


def fixture_upcoming(fixtures: DataFrame, events: DataFrame, teams: DataFrame) -> DataFrame:
    """Unfinished (or unknown) fixtures with gameweek name and both teams' short names.

    ``teams`` plays two roles (home, away); it is broadcast once per role only
    behind a size check.
    """
    f = fixtures.where(not_finished()).alias("f")
    ev = maybe_broadcast(events.select("id", "name")).alias("ev")
    small_teams = maybe_broadcast(teams.select("id", "short_name"))
    th = small_teams.alias("th")
    ta = small_teams.alias("ta")
    return (
        f.join(ev, F.col("f.event_id") == F.col("ev.id"), "left")
        .join(th, F.col("f.team_h") == F.col("th.id"), "left")
        .join(ta, F.col("f.team_a") == F.col("ta.id"), "left")
        .select(
            F.col("f.id"),
            F.col("f.event_id"),
            F.col("ev.name").alias("event_name"),
            F.col("f.team_h"),
            F.col("f.team_a"),
            F.col("th.short_name").alias("team_h_short"),
            F.col("ta.short_name").alias("team_a_short"),
            F.col("f.kickoff_time"),
            F.col("f.finished"),
            F.col("f.team_h_difficulty"),
            F.col("f.team_a_difficulty"),
        )
    )


def last_n_form(
    history: DataFrame,
    fixtures: DataFrame,
    n: int = 5,
    entity: str = "player_id",
    game_key: str = "fixture_id_effective",
    period: str = "event_id",
    minutes: str = "minutes",
    points: str = "total_points",
    fixture_id: str = "id",
    kickoff: str = "kickoff_time",
) -> DataFrame:
    """Rolling last-``n`` games per entity.

    Games are ordered by their fixture's kickoff (newest first, undated last),
    then period (desc, NULL last), then the game key (desc) so ties are
    deterministic. Output: ``games_last{n}``, ``minutes_last{n}``,
    ``points_last{n}``, ``ppg_last{n}``.

    Plan: the kickoff lookup is an equi-join on the fixture key; the rank is a
    ``row_number() <= n`` window, which Catalyst turns into a partial
    ``WindowGroupLimit`` before the shuffle, so a hot entity ships at most
    ``n`` rows per map partition.
    """
    k = fixtures.select(F.col(fixture_id).alias("_fx"), F.col(kickoff).alias("_kickoff"))
    h = history.select(entity, game_key, period, minutes, points)
    joined = h.join(k, h[game_key] == k["_fx"], "left")
    w = Window.partitionBy(entity).orderBy(
        F.col("_kickoff").desc_nulls_last(), F.col(period).desc_nulls_last(), F.col(game_key).desc()
    )
    ranked = joined.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    games = F.count(F.lit(1))
    return ranked.groupBy(entity).agg(
        games.alias(f"games_last{n}"),
        F.sum(minutes).cast("bigint").alias(f"minutes_last{n}"),
        F.sum(points).cast("bigint").alias(f"points_last{n}"),
        (F.sum(points).cast("double") / F.nullif(games, F.lit(0)).cast("double")).alias(f"ppg_last{n}"),
    )


def next_period_id(expected_points: DataFrame, period: str = "event_id") -> DataFrame:
    """One row, one column ``next_event_id``: MIN(period) over the whole table, NULL if empty."""
    return expected_points.agg(F.min(period).alias("next_event_id"))


def xpts_next(expected_points: DataFrame, latest: DataFrame, period: str = "event_id") -> DataFrame:
    """Expected points of the next period joined to the denormalised player.

    The ``MIN`` over the whole table is a scalar subquery (computed once).
    """
    nxt = next_period_id(expected_points, period).scalar()
    x = expected_points.where(F.col(period) == nxt).alias("x")
    p = latest.alias("p")
    return x.join(p, F.col("x.player_id") == F.col("p.id"), "inner").select(
        F.col("x.player_id"),
        F.col(f"x.{period}").alias("event_id"),
        F.col("x.xmins"),
        F.col("x.xpts"),
        F.col("x.xpts_att"),
        F.col("x.xpts_def"),
        F.col("x.xpts_app"),
        F.col("x.computed_at_utc"),
        F.col("p.web_name"),
        F.col("p.team_name"),
        F.col("p.team_short_name"),
        F.col("p.position_short"),
        F.col("p.position_name"),
        F.col("p.now_cost_million"),
        F.col("p.status"),
        F.col("p.minutes"),
        F.col("p.total_points"),
        F.col("p.form"),
        F.col("p.points_per_game"),
    )


def register_marts(tables: dict[str, DataFrame], n: int = 5) -> dict[str, DataFrame]:
    """Create (or replace) the four analytics views as temp views.

    ``tables`` holds silver tables by name: players, teams, element_types,
    events, fixtures, player_match_history and optionally
    player_expected_points. Returns the view DataFrames by view name.
    """
    latest = player_latest(tables["players"], tables["teams"], tables["element_types"])
    views = {
        "v_player_latest": latest,
        "v_fixture_upcoming": fixture_upcoming(tables["fixtures"], tables["events"], tables["teams"]),
        "v_player_form": last_n_form(tables["player_match_history"], tables["fixtures"], n=n),
    }
    if "player_expected_points" in tables:
        views["v_player_xpts_next"] = xpts_next(tables["player_expected_points"], latest)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views
