"""Proof entries for the learned model, the streaming ingest and the
suggestion documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leagueflow.operators import learn, marts
from leagueflow.operators import squads as sq
from leagueflow.plans import proof_ingest as pi
from leagueflow.plans.proof import (
    D, FORM_N, FORM_SQL, HORIZON, ORACLES, PERIODS_SQL, SIDES_SQL, TOP_N, UPCOMING_SQL, XPTS_SQL, _roles, _w, _xpts_frame, proof, round2_sql,
    squad_inputs,
)
from leagueflow.plans.proof_ingest import FUTURE_SQL, HISTORY_BODY, HISTORY_SQL, pick_docs
from leagueflow.plans.proof_squads_sql import answers_sql, best_xi_uncapped_sql, suggestion_docs_sql, suggestion_requests_sql, swaps_service_sql
from leagueflow.plans.roles import AS_OF, role, role_cte
from leagueflow.session import cut_lineage, ensure_checkpoint_dir
from leagueflow.sources import payloads
from leagueflow.sources.tables import KEYS, SCHEMAS, TableStore
from leagueflow.streaming import ingest


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def _train_features(spark, sf):
    r = _roles(spark, sf, "player_match_history", "fixtures", "players", "teams")
    return learn.training_features(r["player_match_history"], r["fixtures"], r["players"], r["teams"])


@proof(
    "train_features",
    role_cte("player_match_history", "fixtures", "players", "teams")
    + f""",
game AS (SELECT player_id, event_id, fixture_id_effective AS game_id, total_points FROM player_match_history WHERE total_points IS NOT NULL),
strength_of AS (SELECT id, coalesce(strength, 3) AS strength FROM teams),
side AS (SELECT id AS game_id, team_h AS team_id, team_a AS opponent, 1 AS is_home, team_h_difficulty AS d FROM fixtures WHERE team_a IS NOT NULL
         UNION ALL SELECT id, team_a, team_h, 0, team_a_difficulty FROM fixtures WHERE team_h IS NOT NULL AND team_h IS DISTINCT FROM team_a),
-- a player whose team plays in neither side counts as away, against the home side
of_player AS (
  SELECT g.*, p.id, p.team_id, p.element_type_id, p.form, p.points_per_game, p.minutes, p.status,
         coalesce(s.is_home, 0) AS is_home, CASE WHEN s.is_home = 1 THEN f.team_a ELSE f.team_h END AS opponent,
         CASE WHEN s.is_home = 1 THEN f.team_h_difficulty ELSE f.team_a_difficulty END AS d
  FROM game g JOIN players p ON p.id = g.player_id AND p.team_id IN (SELECT id FROM strength_of)
  JOIN fixtures f ON f.id = g.game_id AND f.team_h IS NOT NULL AND f.team_a IS NOT NULL
  LEFT JOIN side s ON s.game_id = g.game_id AND s.team_id = p.team_id)
SELECT player_id, event_id, game_id, CAST(coalesce(element_type_id, 3) AS INT) AS element_type_id,
       CAST((SELECT max(strength) FROM strength_of WHERE strength_of.id = of_player.team_id) AS INT) AS team_strength,
       CAST(coalesce((SELECT max(strength) FROM strength_of WHERE strength_of.id = of_player.opponent), 3) AS INT) AS opponent_strength,
       CAST(is_home AS INT) AS is_home, CAST(greatest(1, least(5, coalesce(d, 3))) AS INT) AS difficulty,
       coalesce(form, {D(0.0)}) AS form, coalesce(points_per_game, {D(0.0)}) AS points_per_game,
       least(CAST(coalesce(minutes, 0) AS DOUBLE) / {D(38.0)}, {D(90.0)}) AS minutes_per_game,
       CAST(lower(trim(coalesce(status, ''))) = 'a' AS INT) AS status_available, CAST(total_points AS INT) AS total_points
FROM of_player""",
)
def q_train_features(spark, sf):
    return _train_features(spark, sf)


def _score_features(spark, sf):
    r = _roles(spark, sf, "players", "fixtures", "events", "teams", "player_match_history")
    form = marts.last_n_form(r["player_match_history"], r["fixtures"], n=FORM_N)
    return learn.scoring_features(r["players"], form, r["fixtures"], r["events"], r["teams"], HORIZON, FORM_N)


@proof(
    "score_features",
    role_cte("players", "fixtures", "events", "player_match_history", "teams")
    + ", "
    + _w(FORM_SQL, UPCOMING_SQL, PERIODS_SQL, SIDES_SQL, XPTS_SQL)
    + f"""
SELECT xm.player_id, periods.event_id, xm.element_type_id AS position, xm.xmins,
       CAST(CASE WHEN xm.element_type_id IS NULL OR xm.element_type_id = 0 THEN 3 ELSE xm.element_type_id END AS INT) AS element_type_id,
       CAST(coalesce(ts.strength, 3) AS INT) AS team_strength,
       CAST(CASE WHEN lookup.difficulty IS NOT NULL THEN coalesce(os.strength, 3) ELSE 3 END AS INT) AS opponent_strength,
       CASE WHEN lookup.difficulty IS NOT NULL THEN CAST(lookup.is_home AS INT) ELSE 0 END AS is_home,
       CAST(coalesce(lookup.difficulty, 3) AS INT) AS difficulty,
       coalesce(xm.pform, {D(0.0)}) AS form, coalesce(xm.points_per_game, {D(0.0)}) AS points_per_game,
       least(CAST(coalesce(xm.minutes, 0) AS DOUBLE) / {D(38.0)}, {D(90.0)}) AS minutes_per_game,
       CAST(lower(trim(coalesce(xm.status, ''))) = 'a' AS INT) AS status_available
FROM xm CROSS JOIN periods
LEFT JOIN lookup ON lookup.team_id = xm.team_id AND lookup.event_id = periods.event_id
LEFT JOIN teams ts ON ts.id = xm.team_id
LEFT JOIN teams os ON os.id = lookup.opponent_team""",
)
def q_score_features(spark, sf):
    return _score_features(spark, sf)


TRAIN_SQL = ORACLES["train_features"].rsplit("\nSELECT player_id, event_id, game_id", 1)
SPLIT_SQL = f"""{TRAIN_SQL[0]},
vectors AS (SELECT player_id, event_id, game_id{TRAIN_SQL[1]}),
split AS (SELECT *, CAST('0x' || substr(md5(CAST(player_id AS VARCHAR) || ':' || CAST(game_id AS VARCHAR)), 1, 8) AS BIGINT) < CAST(0.2 * 4294967296 AS BIGINT) AS val FROM vectors)"""
SIZES_SQL = f"""
SELECT CAST(sum(CASE WHEN val THEN 0 ELSE 1 END) AS BIGINT) AS n_train, CAST(sum(CASE WHEN val THEN 1 ELSE 0 END) AS BIGINT) AS n_val,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT {', '.join(learn.FEATURES)} FROM split WHERE NOT val) AS v) AS n_vectors"""


# the oracle repeats the split and the grouping, not the fit; train_step and score_ml check values
@proof("train_mae", SPLIT_SQL + SIZES_SQL + ", TRUE AS mae_is_finite FROM split")
def q_train_mae(spark, sf):
    fit = learn.train(_train_features(spark, sf))
    return spark.createDataFrame([(fit.n_train, fit.n_val, fit.n_vectors, 0 <= float(fit.mae) < float("inf"))], "n_train bigint, n_val bigint, n_vectors bigint, mae_is_finite boolean")


#: Labels with a known answer: points that depend on nothing but the difficulty. One split of one feature gives them exactly.
EASY, HARD, STEP_AT = 6, 2, 2
STEP_SQL = f"CASE WHEN difficulty <= {STEP_AT} THEN {D(EASY)} ELSE {D(HARD)} END"


def _step_model(spark, sf):
    step = F.when(F.col("difficulty") <= STEP_AT, F.lit(EASY)).otherwise(F.lit(HARD))
    return learn.train(_train_features(spark, sf).withColumn(learn.LABEL, step))


@proof("train_step", SPLIT_SQL + SIZES_SQL + f", {D(0.0)} AS mae FROM split")
def q_train_step(spark, sf):
    """A model of labels with a known answer has no error at all."""
    fit = _step_model(spark, sf)
    return spark.createDataFrame([(fit.n_train, fit.n_val, fit.n_vectors, round(float(fit.mae), 9))], "n_train bigint, n_val bigint, n_vectors bigint, mae double")


SHARES_SQL = f"""CASE WHEN coalesce(position, 0) IN (1, 2) THEN {D(0.4)} WHEN coalesce(position, 0) = 3 THEN {D(0.7)} ELSE {D(0.9)} END AS att_share,
       CASE WHEN coalesce(position, 0) IN (1, 2) THEN {D(0.6)} WHEN coalesce(position, 0) = 3 THEN {D(0.3)} ELSE {D(0.1)} END AS def_share"""


@proof("score_ml", f"""
WITH grid AS ({ORACLES["score_features"]}),
shares AS (SELECT *, {STEP_SQL} AS points, {SHARES_SQL} FROM grid)
SELECT player_id, event_id, {round2_sql('xmins')} AS xmins, points AS xpts, {round2_sql('points * att_share')} AS xpts_att,
       {round2_sql('points * def_share')} AS xpts_def, {D(0.0)} AS xpts_app FROM shares""")
def q_score_ml(spark, sf):
    """Trained, saved, loaded, applied to the grid: every predicted value against the known answer."""
    path = _scratch(spark, "model")
    learn.save_model(_step_model(spark, sf).model, path)
    return learn.score(learn.load_model(spark, path), _score_features(spark, sf))


def _streamed(spark, sf, prepare=None) -> TableStore:
    """Bronze JSON Lines from the whole history and future tables → file stream → a store, fresh unless ``prepare`` fills it."""
    r = _roles(spark, sf, "player_match_history", "player_future_fixtures")
    root = _scratch(spark, "stream")
    lines = ingest.summary_lines(r["player_match_history"], r["player_future_fixtures"])
    lines.write.text(f"{root}/bronze")
    store = TableStore(spark, f"{root}/silver")
    if prepare:
        prepare(store)
    ingest.ingest_stream(spark, f"{root}/bronze", store.root, f"{root}/_checkpoint", files_per_batch=2)
    return store


@proof("stream_orphans", f"""{role_cte("player_match_history")}, all_rows AS ({HISTORY_BODY})
SELECT * FROM all_rows WHERE player_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)""")
def q_stream_orphans(spark, sf):
    """The stream over a store that lacks every fifth player: what has no player is set aside."""
    def players(store):
        known = role(spark, sf, "players").where("id % 5 <> 0")
        store.upsert("players", known, ["id"], as_of=AS_OF, orphans="ignore")

    return _streamed(spark, sf, players).read("player_match_history").drop("ingested_at_utc")


@proof("ingest_stream", HISTORY_SQL)
def q_ingest_stream(spark, sf):
    return _streamed(spark, sf).read("player_match_history").drop("ingested_at_utc")


@proof("ingest_stream_future", FUTURE_SQL)
def q_ingest_stream_future(spark, sf):
    return _streamed(spark, sf).read("player_future_fixtures").drop("ingested_at_utc")


ITEM = "array<struct<out_player_id:bigint,in_player_id:bigint,out_web_name:string,in_web_name:string,team_xpts_delta:double,new_team_xpts:double,cost_delta_million:double>>"
DOCUMENT = f"struct<event_id:bigint,current_team_xpts:double,suggestions:{ITEM}>"


@proof("suggestion_docs", suggestion_docs_sql(TOP_N))
def q_suggestion_docs(spark, sf):
    i = squad_inputs(spark, sf)
    s = sq.service_suggestions(i["squads"], i["players"], i["scores"], i["requests"], TOP_N)
    docs = sq.suggestion_documents(s, sq.best_eleven(i["squads"], i["players"], i["scores"], i["requests"], "service"))
    parsed = docs.select("squad_id", F.from_json("document", DOCUMENT).alias("d"))
    return parsed.select("squad_id", "d.event_id", "d.current_team_xpts", F.posexplode_outer("d.suggestions").alias("pos", "s")).select(
        "squad_id", "event_id", "current_team_xpts", "pos", "s.*"
    )


def _given_bank(squads):
    """What the caller sends: nothing, or sums whose tenths are a half."""
    given = F.when(F.col("squad_id") % 3 == 0, F.lit(0.0)).when(F.col("squad_id") % 3 == 1, F.lit(1.25)).otherwise(F.lit(1.35))
    return squads.select("squad_id", given.alias("bank_million"))


def _sent(docs, scores):
    """Money and period that the callers send: half of them name no period, the others one of the two after the next."""
    nxt = marts.next_period_id(scores).scalar()
    named = F.when(F.col("squad_id") % 4 == 2, nxt + 1).when(F.col("squad_id") % 4 == 3, nxt + 2)
    return _given_bank(docs).withColumn("event_id", named)


def _service(spark, sf) -> tuple[TableStore, DataFrame]:
    """Picks documents → request rules → suggestions → response documents, over a store."""
    from leagueflow import jobs

    r = _roles(spark, sf, "squad_players", "squad_scores")
    store = TableStore(spark, _scratch(spark, "service"))
    store.upsert("players", r["squad_players"], ["id"], as_of=AS_OF, orphans="ignore")
    store.upsert("player_expected_points", r["squad_scores"], ["player_id"], as_of=AS_OF, orphans="ignore")
    # a document per squad, made from all line items: made once, not for each reader
    docs = cut_lineage(pick_docs(spark, sf))
    return store, jobs.answer_requests(spark, store, docs, _sent(docs, r["squad_scores"]), TOP_N)


ANSWER = ["squad_id", "status", "event_id", "current_team_xpts", "pos", "out_player_id", "in_player_id", "team_xpts_delta", "cost_delta_million"]


def _listed(answers):
    parsed = answers.drop("event_id").withColumn("d", F.from_json("document", DOCUMENT))
    return parsed.select("squad_id", "status", "d.event_id", "d.current_team_xpts", F.posexplode_outer("d.suggestions").alias("pos", "s")).select(
        "squad_id", "status", "event_id", "current_team_xpts", "pos", "s.*"
    ).select(*ANSWER)


@proof("suggestion_requests", suggestion_requests_sql())
def q_suggestion_requests(spark, sf):
    members, bank = payloads.squad_from_picks(pick_docs(spark, sf), ["squad_id"])
    return sq.suggestion_requests(members, bank, _given_bank(bank), role(spark, sf, "squad_scores"))


@proof("service_answers", answers_sql(TOP_N))
def q_service_answers(spark, sf):
    return _listed(_service(spark, sf)[1])


@proof("documents_sink", answers_sql(TOP_N) + "\nWHERE q.status = 'ok'")
def q_documents_sink(spark, sf):
    """Published, one period published again with other content and then as it was, read back."""
    from leagueflow import jobs

    root = _scratch(spark, "documents")
    _, answers = _service(spark, sf)
    answers = cut_lineage(answers)
    jobs.publish_documents(answers, root)
    last = answers.where(F.col("event_id") == answers.agg(F.max("event_id")).scalar())
    jobs.publish_documents(last.withColumn("document", F.lit("{}")), root)
    jobs.publish_documents(last, root)
    return _listed(sq.read_documents(spark, root).withColumn("status", F.lit("ok")))


SWAP_COLUMNS = ("squad_id", "event_id", "rank", "out_player_id", "in_player_id", "out_web_name", "in_web_name", "team_xpts_delta", "new_team_xpts", "cost_delta_million", "current_team_xpts")


@proof("suggest_job", f"""
WITH found AS (SELECT {', '.join(SWAP_COLUMNS)} FROM ({swaps_service_sql(TOP_N)}) AS s)
SELECT * FROM found UNION ALL
SELECT squad_id, event_id, {', '.join('NULL' for _ in SWAP_COLUMNS[2:-1])}, team_xpts FROM ({best_xi_uncapped_sql()}) AS b WHERE squad_id NOT IN (SELECT squad_id FROM found)""")
def q_suggest_job(spark, sf):
    """The job over a store: swaps of every squad, and one row with its total for a squad without any."""
    from leagueflow import jobs

    r = _roles(spark, sf, "squads", "squad_players", "squad_scores", "squad_bank")
    store = TableStore(spark, _scratch(spark, "suggest"))
    store.upsert("players", r["squad_players"], ["id"], as_of=AS_OF, orphans="ignore")
    store.upsert("player_expected_points", r["squad_scores"], ["player_id"], as_of=AS_OF, orphans="ignore")
    return jobs.suggest_transfers(spark, store, r["squads"], r["squad_bank"], TOP_N, "service").select(*SWAP_COLUMNS)


@proof("suggestions_clamped", f"""
SELECT 0 AS asked, squad_id, rank, out_player_id, in_player_id FROM ({swaps_service_sql(1)}) AS a
UNION ALL SELECT 99, squad_id, rank, out_player_id, in_player_id FROM ({swaps_service_sql(50)}) AS b""")
def q_suggestions_clamped(spark, sf):
    """A service gives 1 to 50 suggestions, whatever it is asked for."""
    i = squad_inputs(spark, sf)
    one, fifty = (sq.service_suggestions(i["squads"], i["players"], i["scores"], i["requests"], n).withColumn("asked", F.lit(n)) for n in (0, 99))
    return one.unionByName(fifty).select("asked", "squad_id", "rank", "out_player_id", "in_player_id")


@proof("store_init", "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({'(SELECT count(*) FROM nation)' if t == 'teams' else 0} AS BIGINT) AS n" for t in SCHEMAS))
def q_store_init(spark, sf):
    """All tables exist after ``init``, empty; one that has rows keeps them when it is called again."""
    store = TableStore(spark, _scratch(spark, "init"))
    store.init()
    store.upsert("teams", role(spark, sf, "teams"), ["id"], as_of=AS_OF)
    store.init()
    out = None
    for t in SCHEMAS:
        c = store.read(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


ALWAYS = 4  # points of every game in the proof of the training job


@proof("train_job", f"""
WITH grid AS ({ORACLES["score_features"]}), shares AS (SELECT *, {SHARES_SQL} FROM grid)
SELECT player_id, event_id, {round2_sql('xmins')} AS xmins, {D(ALWAYS)} AS xpts, {round2_sql(f'{D(ALWAYS)} * att_share')} AS xpts_att,
       {round2_sql(f'{D(ALWAYS)} * def_share')} AS xpts_def, {D(0.0)} AS xpts_app, {D(0.0)} AS mae FROM shares""")
def q_train_job(spark, sf):
    """Training and scoring as jobs over a store in which every game has the same points."""
    from leagueflow import jobs

    store = TableStore(spark, _scratch(spark, "train"))
    for t in ("teams", "element_types", "events", "players", "fixtures", "player_match_history"):
        rows = role(spark, sf, t)
        if t == "player_match_history":
            rows = rows.withColumn("total_points", F.lit(ALWAYS))
        store.upsert(t, rows, KEYS[t], as_of=AS_OF, orphans="ignore")
    path = _scratch(spark, "model")
    mae = jobs.train_xpts(spark, store, path)
    return jobs.compute_scores(spark, store, HORIZON, "ml", path).withColumn("mae", F.lit(round(float(mae), 9)))


# players whose team is unknown are set aside on the way in, so they have no scores
@proof(
    "scores_refresh",
    role_cte("players", "fixtures", "events", "player_match_history", "teams", "element_types")
    .replace("WITH players AS (", "WITH arrived AS (").replace("player_match_history AS (", "arrived_history AS (")
    + ",\nplayer_match_history AS (" + HISTORY_BODY.replace("FROM player_match_history", "FROM arrived_history") + """),
players AS (SELECT * FROM arrived WHERE (team_id IS NULL OR team_id IN (SELECT id FROM teams))
                                    AND (element_type_id IS NULL OR element_type_id IN (SELECT id FROM element_types))), """
    + _w(FORM_SQL, UPCOMING_SQL, PERIODS_SQL, SIDES_SQL, XPTS_SQL)
    + "\nSELECT * FROM xpts",
)
def q_scores_refresh(spark, sf):
    """End to end over a fresh store: core documents → selected summaries → expected points."""
    from leagueflow import jobs

    r = _roles(spark, sf, "teams", "element_types", "events", "players", "fixtures", "player_match_history",
               "player_future_fixtures")

    def doc(df, key, fields):
        return df.groupBy(F.floor(F.col("id") / pi.DOC_ROWS).alias("doc")).agg(
            F.to_json(F.struct(F.collect_list(F.struct(*fields)).alias(key))).alias("payload")
        ).select("payload")

    boot = (
        doc(r["teams"], "teams", ["id", "name", "short_name", "strength"])
        .unionByName(doc(r["element_types"], "element_types", ["id", "singular_name_short", "singular_name", "squad_select"]))
        .unionByName(doc(r["events"], "events", ["id", "name", pi._iso(F.col("deadline_time")).alias("deadline_time"),
                                                 "finished", "is_current", "is_next"]))
        .unionByName(pi.player_docs(r["players"]).select("payload"))
    )
    fx = F.struct("id", F.col("event_id").alias("event"), "team_h", "team_a", pi._iso(F.col("kickoff_time")).alias("kickoff_time"),
                  "finished", "team_h_difficulty", "team_a_difficulty")
    fixture_docs = r["fixtures"].groupBy(F.floor(F.col("id") / pi.DOC_ROWS)).agg(F.to_json(F.collect_list(fx)).alias("payload"))
    store = TableStore(spark, _scratch(spark, "store"))
    jobs.update_core(spark, store, boot, fixture_docs.select("payload"), AS_OF, level="warn", orphans="quarantine")
    jobs.refresh_summaries(spark, store, pi.summary_docs(spark, sf), AS_OF, since_hours=36, level="warn", orphans="quarantine")
    jobs.build_xpts(spark, store, AS_OF, horizon=HORIZON, level="warn")
    return store.read("player_expected_points").drop("computed_at_utc")


def _registered(spark, sf, view: str) -> DataFrame:
    """What SQL on the session sees under the name of a registered view."""
    r = _roles(spark, sf, "players", "teams", "element_types", "fixtures", "events", "player_match_history")
    r["player_expected_points"] = _xpts_frame(spark, sf, AS_OF)
    marts.register_marts(r)
    return spark.sql(f"SELECT * FROM {view}")


for _view, _row in (("v_player_latest", "player_latest"), ("v_fixture_upcoming", "fixture_upcoming"), ("v_player_form", "form_last5"), ("v_player_xpts_next", "xpts_next")):
    proof(f"registered_{_row}", ORACLES[_row])(lambda spark, sf, view=_view: _registered(spark, sf, view))


@proof(
    "marts_registered",
    role_cte("players", "teams", "element_types", "fixtures", "events", "player_match_history")
    + ", " + _w(FORM_SQL, UPCOMING_SQL, PERIODS_SQL, SIDES_SQL, XPTS_SQL)
    + """
SELECT 'v_player_latest' AS view_name, CAST(count(*) AS BIGINT) AS n, 21 AS n_columns FROM players
UNION ALL SELECT 'v_fixture_upcoming', CAST(count(*) AS BIGINT), 11 FROM fixtures WHERE finished = FALSE OR finished IS NULL
UNION ALL SELECT 'v_player_form', CAST(count(*) AS BIGINT), 5 FROM form
UNION ALL SELECT 'v_player_xpts_next', CAST(count(*) AS BIGINT), 19 FROM xpts x JOIN players p ON x.player_id = p.id
          WHERE x.event_id = (SELECT min(event_id) FROM xpts)""",
)
def q_marts_registered(spark, sf):
    r = _roles(spark, sf, "players", "teams", "element_types", "fixtures", "events", "player_match_history")
    r["player_expected_points"] = _xpts_frame(spark, sf, AS_OF)
    views = marts.register_marts(r)
    out = None
    for name in views:
        view = spark.table(name)
        c = view.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("view_name"), "n", F.lit(len(view.columns)).alias("n_columns"))
        out = c if out is None else out.unionByName(c)
    return out


def _bronze(spark, sf) -> str:
    """Events as fetches → bronze JSON Lines, partitioned."""
    from leagueflow.plans.roles import read_table

    root = _scratch(spark, "bronze")
    ev = read_table(spark, sf, "events")
    fetches = ev.select(
        F.when(F.col("event_id") % 7 == 0, F.lit("fixtures")).otherwise(F.lit("element-summary")).alias("endpoint"),
        F.concat(F.lit("element-summary:"), F.col("event_id").cast("string")).alias("request_key"),
        F.col("ts").alias("fetched_at_utc"),
        F.concat(F.lit(pi.BASE), F.lit("element-summary/"), F.col("event_id").cast("string"), F.lit("/")).alias("url"),
        F.col("props").alias("payload"),
    )
    payloads.write_bronze(fetches, root)
    return root


@proof("bronze_roundtrip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_bronze_roundtrip(spark, sf):
    """Bronze files → envelope parse → payload field back."""
    env = ingest.envelope(payloads.read_bronze(spark, _bronze(spark, sf)))
    return env.select(F.col("player_id").alias("event_id"), F.get_json_object("payload", "$.k").cast("bigint").alias("k"))


FIRST_DAY, LAST_DAY = "2024-01-05", "2024-01-20"
IN_PATH = r"/endpoint=([^/]*)/fetch_date=([^/]*)/[^/]+$"


@proof(
    "bronze_lineage",
    f"""
SELECT event_id, 'element-summary' AS endpoint, strftime(ts, '%Y-%m-%d') AS fetch_date, '{pi.BASE}element-summary/' || CAST(event_id AS VARCHAR) || '/' AS url,
       TRUE AS written_before_now
FROM events WHERE event_id % 7 <> 0 AND strftime(ts, '%Y-%m-%d') BETWEEN '{FIRST_DAY}' AND '{LAST_DAY}'""",
)
def q_bronze_lineage(spark, sf):
    """One endpoint and some days of the bronze files, with the file of every fetch; endpoint and day come from its path."""
    lines = payloads.read_bronze(spark, _bronze(spark, sf), "element-summary", FIRST_DAY, LAST_DAY)
    env = ingest.envelope(lines)
    path = F.col("payload_path")
    times = lines.agg(F.max("file_time_utc") <= F.to_timestamp_ntz(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))).scalar()
    return env.select(F.col("player_id").alias("event_id"), F.regexp_extract(path, IN_PATH, 1).alias("endpoint"), F.regexp_extract(path, IN_PATH, 2).alias("fetch_date"), "url", times.alias("written_before_now"))


@proof(
    "log_lineage",
    f"""
SELECT 'element-summary:' || CAST(event_id AS VARCHAR) AS request_key, 'element-summary' AS endpoint, ts_s AS fetched_at_utc,
       '{pi.BASE}element-summary/' || CAST(event_id AS VARCHAR) || '/' AS url, strftime(ts_s, '%Y-%m-%d') AS path_day,
       sha256('{{"k":' || json_extract_string(props, '$.k') || '}}') AS payload_sha256
FROM (SELECT *, date_trunc('second', ts) AS ts_s FROM events) AS e WHERE event_id % 7 <> 0""",
)
def q_log_lineage(spark, sf):
    """A stream over one endpoint of the bronze files: its log says where every fetch came from and lies."""
    root = _bronze(spark, sf)
    ingest.ingest_stream(spark, root, f"{root}-silver", f"{root}-checkpoint", files_per_batch=64, endpoint="element-summary")
    log = TableStore(spark, f"{root}-silver").read("meta_ingestions")
    return log.select("request_key", "endpoint", "fetched_at_utc", "url", F.regexp_extract("payload_path", IN_PATH, 2).alias("path_day"), "payload_sha256")
