"""Column expressions of the explainable expected-points formula.

Each function maps input columns to one output column, so a scoring job is a
single projection over a (player, period) grid and stays in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leagueflow.functions.casts import clamp

# Fixture difficulty (1 easiest .. 5 hardest) → points multiplier.
DIFFICULTY_MULTIPLIER = {1: 1.15, 2: 1.05, 3: 1.00, 4: 0.92, 5: 0.85}
# Status codes that scale expected minutes, and the factor.
PENALISED_STATUS = ("i", "s", "u", "d")
PENALTY_FACTOR = 0.4
# Attacking / defensive share of non-appearance points by position
# (1 = goalkeeper, 2 = defender, 3 = midfielder, 4 = forward; others as forward).
ATT_DEF_SHARE = {1: (0.4, 0.6), 2: (0.4, 0.6), 3: (0.7, 0.3)}
OTHER_ATT_DEF_SHARE = (0.9, 0.1)
# A full match, the appearance points stripped from the per-90 rate,
# and the neutral difficulty used when a team has no fixture in a period.
FULL_MATCH_MINUTES = 90.0
APPEARANCE_STRIP = 2.0
NEUTRAL_DIFFICULTY = 3


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def difficulty_multiplier(difficulty: Column | str) -> Column:
    """1→1.15, 2→1.05, 3→1.00, 4→0.92, 5→0.85; anything else or NULL → 1.0."""
    d = _col(difficulty)
    expr = None
    for level, mult in DIFFICULTY_MULTIPLIER.items():
        expr = (F.when(d == level, F.lit(mult)) if expr is None else expr.when(d == level, F.lit(mult)))
    return expr.otherwise(F.lit(1.0))


def status_key(status: Column | str) -> Column:
    """NULL → '', trimmed, lower case."""
    return F.lower(F.trim(F.coalesce(_col(status), F.lit(""))))


def att_def_share(element_type: Column | str) -> tuple[Column, Column]:
    """(attacking share, defensive share) of non-appearance points by position."""
    e = F.coalesce(_col(element_type), F.lit(0))
    att = F.lit(OTHER_ATT_DEF_SHARE[0])
    dfn = F.lit(OTHER_ATT_DEF_SHARE[1])
    for pos in sorted(ATT_DEF_SHARE, reverse=True):
        a, d = ATT_DEF_SHARE[pos]
        att = F.when(e == pos, F.lit(a)).otherwise(att)
        dfn = F.when(e == pos, F.lit(d)).otherwise(dfn)
    return att, dfn


def expected_minutes(
    games_last: Column | str,
    minutes_last: Column | str,
    season_minutes: Column | str,
    finished_periods: Column | str,
    status: Column | str,
    min_games: int = 3,
) -> Column:
    """Expected minutes for one period.

    Recent average (capped at 90) when at least ``min_games`` recent games with
    known minutes exist; else season minutes per finished period (at least 1),
    capped at 90. Unavailable statuses scale the result by 0.4. Never below 0.
    """
    g = F.coalesce(_col(games_last), F.lit(0))
    m = _col(minutes_last)
    recent = F.least(F.lit(FULL_MATCH_MINUTES), m.cast("double") / g.cast("double"))
    season = F.least(
        F.lit(FULL_MATCH_MINUTES),
        F.coalesce(_col(season_minutes), F.lit(0)).cast("double")
        / F.greatest(F.lit(1), F.coalesce(_col(finished_periods), F.lit(0))).cast("double"),
    )
    raw = F.when((g >= min_games) & m.isNotNull(), recent).otherwise(season)
    scaled = F.when(status_key(status).isin(*PENALISED_STATUS), raw * F.lit(PENALTY_FACTOR)).otherwise(raw)
    return F.greatest(F.lit(0.0), scaled)


def point_components(
    xmins: Column | str,
    minutes_last: Column | str,
    points_last: Column | str,
    points_per_game: Column | str,
    element_type: Column | str,
    multiplier: Column | str,
) -> dict[str, Column]:
    """Unrounded expected-points components: app, att, def and total."""
    xm = _col(xmins)
    p60 = clamp(xm / F.lit(FULL_MATCH_MINUTES), 0.0, 1.0)
    app = F.when(xm > 0, F.lit(1.0)).otherwise(F.lit(0.0)) + p60
    m5 = F.coalesce(_col(minutes_last), F.lit(0))
    pt5 = F.coalesce(_col(points_last), F.lit(0))
    rate = F.when(
        m5 > 0, (pt5.cast("double") / m5.cast("double")) * F.lit(FULL_MATCH_MINUTES)
    ).otherwise(F.coalesce(_col(points_per_game).cast("double"), F.lit(0.0)))
    nonapp_rate = F.greatest(F.lit(0.0), rate - F.lit(APPEARANCE_STRIP))
    nonapp = nonapp_rate * (xm / F.lit(FULL_MATCH_MINUTES)) * _col(multiplier)
    att_share, def_share = att_def_share(element_type)
    return {
        "xpts_app": app,
        "xpts_att": nonapp * att_share,
        "xpts_def": nonapp * def_share,
        "xpts": app + nonapp,
    }
