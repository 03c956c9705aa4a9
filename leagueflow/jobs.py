"""Jobs: the operators chained over the table store.

Each job reads documents or silver tables, upserts, logs its fetches and runs
the quality gate after the commit, as the source system does (level hard |
strict | warn), and with ``gate_first`` also before it. Buckets with more than
``most_deltas`` folders are compacted after the write. ``as_of`` stamps written rows, so reruns are reproducible.
Rows whose parent does not exist are rejected; ``orphans="quarantine"`` sets
them aside and stores the rest.

Documents are rows of ``payload`` and, where they have them, ``request_key``
and ``fetched_at_utc``; what is missing is filled in from the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.operators import incremental, learn, marts, quality, scoring
from leagueflow.operators import squads as sq
from leagueflow.session import cut_lineage, keyed
from leagueflow.sources import payloads
from leagueflow.sources.tables import MOST_DELTAS, TableStore
from leagueflow.streaming.ingest import ORDER, fetch_log, ordered

CORE = ("teams", "element_types", "events", "players", "fixtures")


def _batch_gate(spark: SparkSession, level: str, before: bool) -> quality.BatchGate | None:
    return quality.BatchGate(spark, level) if before else None


def _gate(spark: SparkSession, store: TableStore, level: str) -> DataFrame:
    """Gate over the tables that exist; one that does not is an error of the report."""
    tables = {t: store.read(t) for t in quality.CORE_TABLES if store.exists(t)}
    report = quality.quality_report(spark, tables)
    quality.enforce(report, level)
    return report


def _documents(docs: DataFrame, key, as_of: str) -> DataFrame:
    """Documents with key, fetch time and digests, parsed once."""
    if "request_key" not in docs.columns:
        docs = docs.withColumn("request_key", key)
    if "fetched_at_utc" not in docs.columns:
        docs = docs.withColumn("fetched_at_utc", F.lit(as_of).cast("timestamp_ntz"))
    return ordered(docs)


def update_core(
    spark: SparkSession,
    store: TableStore,
    bootstrap_docs: DataFrame,
    fixture_docs: DataFrame,
    as_of: str,
    level: str = "hard",
    run_id: str | None = None,
    orphans: str = "reject",
    gate_first: bool = False,
    most_deltas: int = MOST_DELTAS,
) -> dict[str, int]:
    """Core snapshot + fixtures → five upserts and the log, then the quality gate.

    Each document is parsed once; the variant is kept and fanned out to its
    tables. ``gate_first`` also holds every batch against ``level`` before it
    counts: the first one that fails leaves its table as it was.
    """
    store.init()
    boot = _documents(bootstrap_docs, F.lit("bootstrap-static"), as_of).persist()
    fixtures = _documents(fixture_docs, F.lit("fixtures"), as_of).persist()
    parse = {
        "teams": (payloads.parse_teams, boot),
        "element_types": (payloads.parse_positions, boot),
        "events": (payloads.parse_events, boot),
        "players": (payloads.parse_players, boot),
        "fixtures": (payloads.parse_fixtures, fixtures),
    }
    check = _batch_gate(spark, level, gate_first)
    try:
        counts = {
            t: store.upsert(t, f(docs, keep=ORDER[:2], pos="_pos"), ORDER, as_of=as_of, orphans=orphans, check=check) for t, (f, docs) in parse.items()
        }
        log = fetch_log(boot, "bootstrap-static", run_id).unionByName(fetch_log(fixtures, "fixtures", run_id))
        store.log_fetches(log, part=run_id and f"core-{run_id}")
    finally:
        boot.unpersist()
        fixtures.unpersist()
    for t in [*parse, "last_fetches"]:
        store.compact(t, most_deltas)
    _gate(spark, store, level)
    return counts


def update_summaries(
    spark: SparkSession,
    store: TableStore,
    summary_docs: DataFrame,
    as_of: str,
    level: str = "hard",
    player: str = "player_id",
    run_id: str | None = None,
    orphans: str = "reject",
    gate_first: bool = False,
    most_deltas: int = MOST_DELTAS,
) -> dict[str, int]:
    """Per-player summary documents → history and future-fixture upserts and the log, then the gate."""
    store.init()
    key = F.concat(F.lit("element-summary:"), F.col(player).cast("string"))
    docs = _documents(summary_docs, key, as_of).persist()
    check = _batch_gate(spark, level, gate_first)
    parse = {"player_match_history": payloads.parse_history, "player_future_fixtures": payloads.parse_future}
    try:
        counts = {
            t: store.upsert(t, f(docs, player, keep=ORDER[:2], pos="_pos").withColumnRenamed(player, "player_id"), ORDER, as_of=as_of, orphans=orphans, check=check)
            for t, f in parse.items()
        }
        store.log_fetches(fetch_log(docs, "element-summary", run_id), part=run_id and f"summaries-{run_id}")
    finally:
        docs.unpersist()
    for t in [*parse, "last_fetches"]:
        store.compact(t, most_deltas)
    _gate(spark, store, level)
    return counts


def refresh_summaries(
    spark: SparkSession,
    store: TableStore,
    available_docs: DataFrame,
    as_of: str,
    top_n: int | None = None,
    since_hours: float | None = None,
    max_age_hours: float | None = None,
    force: bool = False,
    player: str = "player_id",
    **kw,
) -> dict[str, int]:
    """Selection, then ingest: of the documents that could be fetched, those of players whose last fetch makes them due."""
    candidates = incremental.top_candidates(store.read("players"), top_n)
    due = incremental.select_incremental(candidates, store.read("last_fetches"), as_of, since_hours, max_age_hours, force)
    # written once: the ingest changes the fetches that the selection reads
    due = cut_lineage(due.select(F.col("player_id").alias("_due")))
    docs = available_docs.join(due, available_docs[player] == due["_due"], "left_semi")
    return update_summaries(spark, store, docs, as_of, player=player, **kw)


def register_views(store: TableStore, n: int = 5) -> dict[str, DataFrame]:
    """Publish the four analytics views over the current tables."""
    store.init()
    names = list(CORE) + ["player_match_history", "player_expected_points"]
    return marts.register_marts({t: store.read(t) for t in names}, n=n)


def compute_scores(
    spark: SparkSession, store: TableStore, horizon: int = 3, method: str = "baseline", model_path: str | None = None
) -> DataFrame:
    """Expected points for the next ``horizon`` periods (not written)."""
    t = {name: store.read(name) for name in ("players", "fixtures", "events", "teams", "player_match_history")}
    form = marts.last_n_form(t["player_match_history"], t["fixtures"])
    if method == "ml":
        model = learn.load_model(spark, model_path)
        feats = learn.scoring_features(t["players"], form, t["fixtures"], t["events"], t["teams"], horizon)
        return learn.score(model, feats)
    return scoring.baseline_scores(t["players"], form, t["fixtures"], t["events"], horizon)


def build_xpts(
    spark: SparkSession,
    store: TableStore,
    as_of: str,
    horizon: int = 3,
    method: str = "baseline",
    model_path: str | None = None,
    level: str = "hard",
    orphans: str = "reject",
    gate_first: bool = False,
    most_deltas: int = MOST_DELTAS,
) -> DataFrame:
    """Compute, upsert into ``player_expected_points``, gate; returns the top-10 report of this run's scores."""
    scores = cut_lineage(compute_scores(spark, store, horizon, method, model_path))
    store.upsert("player_expected_points", scores, ["player_id"], as_of=as_of, orphans=orphans, check=_batch_gate(spark, level, gate_first))
    store.compact("player_expected_points", most_deltas)
    _gate(spark, store, level)
    return scoring.top_scores(scores, 10)


def train_xpts(spark: SparkSession, store: TableStore, model_path: str, validation_fraction: float = 0.2) -> float:
    """Train the model from stored history and save it; returns the validation MAE."""
    t = {name: store.read(name) for name in ("player_match_history", "fixtures", "players", "teams")}
    feats = learn.training_features(t["player_match_history"], t["fixtures"], t["players"], t["teams"])
    fit = learn.train(feats, validation_fraction)
    learn.save_model(fit.model, model_path)
    return fit.mae


def _requests(store: TableStore, squads: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores, and the requests: each squad with its money and the period that the caller names, else the next one."""
    scores = store.read("player_expected_points")
    nxt = marts.next_period_id(scores).scalar()
    period = F.coalesce(F.col("event_id").cast("bigint"), nxt) if "event_id" in asked.columns else nxt
    # read by the scores, the buyers, the sellers and the elevens: written once
    requests = cut_lineage(
        squads.select("squad_id").distinct()
        .join(keyed(asked), "squad_id", "left")
        .withColumn("_next", nxt)
        .where(F.col("_next").isNotNull())
        .select("squad_id", period.alias("event_id"), F.coalesce("bank_tenths", F.lit(0)).cast("bigint").alias("bank_tenths"))
    )
    return scores, requests


def suggest_transfers(
    spark: SparkSession, store: TableStore, squads: DataFrame, bank_tenths: DataFrame, top_n: int = 10, preset: str = "cli"
) -> DataFrame:
    """Suggestions for many squads, each for the period it asks for.

    ``squads``: (squad_id, slot, player_id); ``bank_tenths``: (squad_id,
    bank_tenths) and, if callers name a period, ``event_id`` (NULL: the next
    period in ``player_expected_points``).
    A squad without a feasible swap has one row with its current total and no
    rank. No stored scores → empty result.
    """
    scores, requests = _requests(store, squads, bank_tenths)
    players = store.read("players")
    suggest = sq.cli_suggestions if preset == "cli" else sq.service_suggestions
    found = cut_lineage(suggest(squads, players, scores, requests, top_n))
    current = sq.best_eleven(squads, players, scores, requests, preset)
    none = current.join(found.select("squad_id").distinct(), "squad_id", "left_anti")
    return found.unionByName(none.select("squad_id", "event_id", F.col("team_xpts").alias("current_team_xpts")), allowMissingColumns=True)


def answer_requests(
    spark: SparkSession, store: TableStore, picks_docs: DataFrame, given_bank: DataFrame, top_n: int = 10
) -> DataFrame:
    """The service end to end: picks documents → request rules → suggestions → one document per accepted squad.

    ``picks_docs``: (squad_id, payload); ``given_bank``: what the caller sends,
    (squad_id, bank_million) and, if named, the period ``event_id`` (NULL: the
    next one). Returns ``squad_id, event_id, status, document``; squads that
    the rules refuse have their status and no document.
    """
    # each document is parsed once; the picks, at most a squad's, and what is asked are read more than once
    docs = payloads.parsed(picks_docs).persist()
    try:
        members, bank = payloads.squad_from_picks(docs, ["squad_id"])
        members = cut_lineage(members)
        asked = cut_lineage(sq.suggestion_requests(members, bank, given_bank, store.read("player_expected_points")))
    finally:
        docs.unpersist()
    ok = asked.where(F.col("status") == "ok")
    squads = members.join(ok.select("squad_id"), "squad_id", "left_semi").select("squad_id", F.col("pick_index").cast("int").alias("slot"), "player_id")
    money = ok.select("squad_id", "bank_tenths")
    if "event_id" in given_bank.columns:
        money = money.join(keyed(given_bank.select("squad_id", "event_id")), "squad_id", "left")
    scores, requests = _requests(store, squads, money)
    players = store.read("players")
    current = sq.best_eleven(squads, players, scores, requests, "service")
    documents = sq.suggestion_documents(sq.service_suggestions(squads, players, scores, requests, top_n), current)
    return asked.join(documents, "squad_id", "left").select("squad_id", "event_id", "status", "document")


def publish_documents(answers: DataFrame, root: str) -> None:
    """Write the answers of accepted squads as JSON Lines, one folder per period; a period written again is replaced alone."""
    sq.write_documents(answers.where(F.col("status") == "ok").select("squad_id", "event_id", "document"), root)
