"""Data-quality checks with hard / warning severities and a publish gate.

Each table is scanned once: all counts, NULL counts and range violations of
a table are conditional aggregates of a single pass. The report is a
long-format DataFrame ``(check, subject, severity, n, pct, failed)``; the gate
is one more aggregate over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.functions.casts import round2
from leagueflow.sources.tables import Check, fk_violations


class QualityError(RuntimeError):
    """Raised by :func:`enforce` when the gate fails at the requested level."""


@dataclass(frozen=True)
class Rules:
    # The source system's quality bounds.
    min_players: int = 600  # warn unless players > 600
    fixtures_lo: int = 300
    fixtures_hi: int = 400
    minutes_lo: int = 0  # hard
    minutes_hi: int = 130
    points_lo: int = -10  # warn
    points_hi: int = 40
    sample_limit: int = 10


CORE_TABLES = (
    "teams", "element_types", "events", "players", "fixtures",
    "player_match_history", "player_future_fixtures", "player_expected_points",
)

# (table, column, severity when NULLs are present)
NULL_CHECKS = (
    ("players", "id", "error"),
    ("players", "team_id", "error"),
    ("fixtures", "id", "error"),
    ("fixtures", "event_id", "info"),
    ("player_match_history", "player_id", "error"),
    ("player_match_history", "fixture_id_effective", "error"),
)

REPORT_SCHEMA = "check string, subject string, severity string, n bigint, pct double, failed boolean"


def _row(check: str, subject: str, severity: str, n, pct, failed) -> list:
    return [
        F.lit(check).alias("check"),
        F.lit(subject).alias("subject"),
        F.lit(severity).alias("severity"),
        (n if n is not None else F.lit(None)).cast("bigint").alias("n"),
        (pct if pct is not None else F.lit(None)).cast("double").alias("pct"),
        failed.cast("boolean").alias("failed"),
    ]


def _stack(one_row: DataFrame, rows: list[list]) -> DataFrame:
    """Turn several report rows computed over one 1-row aggregate into rows."""
    structs = [F.struct(*r) for r in rows]
    return one_row.select(F.inline(F.array(*structs)))


def _null_checks(table: str) -> list[tuple[str, str]]:
    return [(c, severity) for t, c, severity in NULL_CHECKS if t == table]


def metrics(table: str, rules: Rules = Rules()) -> list:
    """Everything one pass over a table has to count."""
    out = [F.count(F.lit(1)).alias("total")]
    out += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c, _ in _null_checks(table)]
    if table == "player_match_history":
        for name, c, lo, hi in (("bad_minutes", "minutes", rules.minutes_lo, rules.minutes_hi), ("bad_points", "total_points", rules.points_lo, rules.points_hi)):
            out.append(F.count_if(F.col(c).isNotNull() & ((F.col(c) < lo) | (F.col(c) > hi))).alias(name))
    return out


def _checks(table: str, rules: Rules, whole_table: bool = True) -> list[list]:
    """Report rows over the one row of :func:`metrics`; bounds on the number of rows hold for whole tables only."""
    total = F.col("total")
    rows = [_row("count", table, "info", total, None, F.lit(False))]
    if table == "players" and whole_table:
        rows.append(_row("row_count_range", table, "warn", total, None, total <= rules.min_players))
    if table == "fixtures" and whole_table:
        rows.append(_row("row_count_range", table, "warn", total, None, ~total.between(rules.fixtures_lo, rules.fixtures_hi)))
    for c, severity in _null_checks(table):
        n = F.col(f"null_{c}")
        pct = round2(F.lit(100.0) * n.cast("double") / total.cast("double"))
        # an empty table is skipped, like the source system does
        rows.append(_row("null_pct", f"{table}.{c}", severity, F.when(total > 0, n), F.when(total > 0, pct),
                         (total > 0) & (n > 0) & F.lit(severity == "error")))
    if table == "player_match_history":
        rows.append(_row("minutes_range", f"{table}.minutes", "error", F.col("bad_minutes"), None, F.col("bad_minutes") > 0))
        rows.append(_row("points_range", f"{table}.total_points", "warn", F.col("bad_points"), None, F.col("bad_points") > 0))
    return rows


def _without_empty(report: DataFrame) -> DataFrame:
    """NULL-check rows of empty tables are not reported."""
    return report.where(~((F.col("check") == "null_pct") & F.col("n").isNull()))


def quality_report(spark: SparkSession, tables: dict[str, DataFrame], rules: Rules = Rules()) -> DataFrame:
    """All checks over the given tables (missing core tables become hard errors)."""
    parts: list[DataFrame] = []
    missing = [t for t in CORE_TABLES if t not in tables]
    if missing:
        parts.append(
            spark.createDataFrame([("table_exists", t, "error", None, None, True) for t in missing], REPORT_SCHEMA)
        )
    for t in [t for t in CORE_TABLES if t in tables]:
        parts.append(_stack(tables[t].agg(*metrics(t, rules)), _checks(t, rules)))
    for child, fk, parent, name in (("players", "team_id", "teams", "players.team_id->teams.id"),
                                   ("fixtures", "event_id", "events", "fixtures.event_id->events.id")):
        if child in tables and parent in tables:
            o = fk_violations(tables[child], fk, tables[parent]).agg(F.count(F.lit(1)).alias("n"))
            parts.append(_stack(o, [_row("orphans", name, "error", F.col("n"), None, F.col("n") > 0)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _without_empty(out)


class BatchGate(Check):
    """Gate before a batch counts: the checks on its rows, from metrics that the writing pass observes.

    Orphans are looked for before the write, and bounds on a table's number of
    rows belong to the gate over whole tables. ``reports`` keeps the figures of
    every batch, of refused ones too.
    """

    def __init__(self, spark: SparkSession, level: str = "hard", rules: Rules = Rules()):
        if level not in LEVELS:
            raise ValueError(f"unknown level {level}")
        self._spark, self.level, self.rules = spark, level, rules
        self.reports: dict[str, DataFrame] = {}
        super().__init__(lambda t: metrics(t, rules) if t in CORE_TABLES else [], self._accept)

    def _accept(self, table: str, seen: dict) -> None:
        one = self._spark.createDataFrame([tuple(seen.values())], ", ".join(f"{c} bigint" for c in seen))
        self.reports[table] = _without_empty(_stack(one, _checks(table, self.rules, whole_table=False)))
        enforce(self.reports[table], self.level)


def sample_anomalies(history: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Up to ``sample_limit`` history rows with minutes or points out of bounds (by key)."""
    mins, pts = F.col("minutes"), F.col("total_points")
    weird = (mins.isNotNull() & ((mins < rules.minutes_lo) | (mins > rules.minutes_hi))) | (
        pts.isNotNull() & ((pts < rules.points_lo) | (pts > rules.points_hi))
    )
    return (
        history.where(weird)
        .select("player_id", "fixture_id_effective", "minutes", "total_points")
        .orderBy("player_id", "fixture_id_effective")
        .limit(rules.sample_limit)
    )


LEVELS = ("hard", "strict", "warn")


def gate_levels(report: DataFrame) -> DataFrame:
    """A row per level: ``level``, ``errors``, ``warnings``, ``should_fail``, all from one pass over the report."""
    counts = report.agg(
        F.count_if(F.col("failed") & (F.col("severity") == "error")).alias("errors"),
        F.count_if(F.col("failed") & (F.col("severity") == "warn")).alias("warnings"),
    )
    fails = {"hard": F.col("errors") > 0, "strict": (F.col("errors") > 0) | (F.col("warnings") > 0), "warn": F.lit(False)}
    return _stack(counts, [[F.lit(x).alias("level"), F.col("errors").alias("errors"), F.col("warnings").alias("warnings"), fails[x].alias("should_fail")] for x in LEVELS])


def gate(report: DataFrame, level: str = "hard") -> DataFrame:
    """One row: ``errors``, ``warnings``, ``should_fail`` for level hard | strict | warn."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    return gate_levels(report).where(F.col("level") == level).drop("level")


def enforce(report: DataFrame, level: str = "hard") -> None:
    """Raise :class:`QualityError` when the gate fails (one small action)."""
    row = gate(report, level).first()
    if row["should_fail"]:
        raise QualityError(f"quality gate '{level}' failed: {row['errors']} errors, {row['warnings']} warnings")
