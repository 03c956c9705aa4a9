import json

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from leagueflow import jobs
from leagueflow.operators import learn, quality, scoring
from leagueflow.operators import squads as sq
from leagueflow.plans.roles import role
from leagueflow.sources import tables
from leagueflow.sources.tables import TableStore
from leagueflow.streaming import ingest

SF = "/root/testdata/sf0.001"
AS_OF = "2024-01-31 00:00:00"
LOADED = ("teams", "element_types", "events", "players", "fixtures", "player_match_history", "player_future_fixtures")


def _store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "silver"))
    store.init()
    for t in LOADED:
        assert store.upsert(t, role(spark, SF, t), tables.KEYS[t], as_of=AS_OF, orphans="ignore") > 0
    return store


def _squads(spark, store, sizes=((1, 15), (2, 15))):
    p = store.read("players").where(F.col("element_type_id").isNotNull() & F.col("team_id").isNotNull())
    picks = []
    for sid, size in sizes:
        slot = 0
        for role_id, need in ((1, 2), (2, 5), (3, 5), (4, 3)):
            ids = [r.id for r in p.where(F.col("element_type_id") == role_id).orderBy("id").limit(need + 5 * sid).collect()][-need:]
            for pid in ids:
                slot += 1
                if slot <= size:
                    picks.append((sid, slot, pid))
    return spark.createDataFrame(picks, "squad_id bigint, slot int, player_id bigint")


def test_build_views_and_suggest(spark, tmp_path):
    store = _store(spark, tmp_path)
    top = jobs.build_xpts(spark, store, AS_OF, horizon=3, level="warn", orphans="quarantine")
    assert 0 < top.count() <= 10
    views = jobs.register_views(store)
    assert set(views) == {"v_player_latest", "v_fixture_upcoming", "v_player_form", "v_player_xpts_next"}
    assert len(spark.table("v_player_latest").columns) == 21 and len(spark.table("v_player_xpts_next").columns) == 19
    assert spark.table("v_player_xpts_next").where("computed_at_utc IS NULL").count() == 0
    squads = _squads(spark, store)
    # squad 3 has no money and one member that costs nothing: nobody can be bought for it
    free = spark.createDataFrame([(10**6, "free", "a", "b", 1, 1, 0)], "id bigint, web_name string, first_name string, second_name string, team_id bigint, element_type_id bigint, now_cost int")
    store.upsert("players", free, ["id"], as_of=AS_OF)
    squads = squads.unionByName(spark.createDataFrame([(3, 1, 10**6)], "squad_id bigint, slot int, player_id bigint"))
    bank = spark.createDataFrame([(1, 5), (2, 0), (3, -1)], "squad_id bigint, bank_tenths bigint")
    period = store.read("player_expected_points").agg(F.min("event_id")).first()[0]
    for preset in ("cli", "service"):
        rows = jobs.suggest_transfers(spark, store, squads, bank, top_n=5, preset=preset).collect()
        assert {r.event_id for r in rows} == {period}
        assert [r["rank"] for r in rows if r.squad_id == 3] == [None]
        assert sorted(r["rank"] for r in rows if r.squad_id == 1) == [1, 2, 3, 4, 5]


def test_requests_lead_to_documents(spark, tmp_path):
    store = _store(spark, tmp_path)
    jobs.build_xpts(spark, store, AS_OF, level="warn", orphans="quarantine")
    squads = _squads(spark, store, ((1, 15), (2, 14)))
    docs = [(s, json.dumps({"picks": [{"element": r.player_id} for r in squads.where(F.col("squad_id") == s).orderBy("slot").collect()], "entry_history": {"bank": 25}})) for s in (1, 2)]
    given = spark.createDataFrame([(1, 0.0, None)], "squad_id bigint, bank_million double, event_id bigint")
    rows = {r.squad_id: r for r in jobs.answer_requests(spark, store, spark.createDataFrame(docs, "squad_id bigint, payload string"), given, 3).collect()}
    assert rows[2].status == "bad_squad_size" and rows[2].document is None
    answer = json.loads(rows[1].document)
    assert rows[1].status == "ok" and len(answer["suggestions"]) == 3 and answer["current_team_xpts"] > 0


def test_report_is_of_this_run(spark, tmp_path):
    """Scores of earlier periods that lie in the table are not reported."""
    store = _store(spark, tmp_path)
    stale = spark.createDataFrame([(1, 1, 99.0)], "player_id bigint, event_id bigint, xpts double")
    store.upsert("player_expected_points", stale, ["player_id"], as_of=AS_OF, orphans="ignore")
    top = jobs.build_xpts(spark, store, AS_OF, level="warn", orphans="quarantine")
    first = scoring.next_periods(store.read("fixtures").where("NOT coalesce(finished, false)"), 1).first()[0]
    assert {r.event_id for r in top.collect()} == {first}


def test_every_ingest_is_logged_and_selection_follows_the_log(spark, tmp_path):
    store = _store(spark, tmp_path)
    docs = ingest.summary_docs(role(spark, SF, "player_match_history"), role(spark, SF, "player_future_fixtures"))
    players = role(spark, SF, "players").select("id")
    expected = docs.join(players, docs["player_id"] == players["id"], "left_semi").count()
    kw = dict(since_hours=24, level="warn", orphans="quarantine")
    jobs.refresh_summaries(spark, store, docs, AS_OF, run_id="one", **kw)
    assert store.read("meta_ingestions").where("run_id = 'one'").count() == expected > 0
    jobs.refresh_summaries(spark, store, docs, "2024-01-31 12:00:00", run_id="two", **kw)
    never = docs.select("player_id").distinct().count()
    assert store.read("meta_ingestions").where("run_id = 'two'").count() == 0 and never > 0
    jobs.refresh_summaries(spark, store, docs, "2024-02-03 00:00:00", run_id="three", **kw)
    assert store.read("meta_ingestions").where("run_id = 'three'").count() == expected


def test_orphans_are_rejected_or_set_aside(spark, tmp_path):
    store = _store(spark, tmp_path)
    docs = spark.createDataFrame([(10**9, json.dumps({"history": [{"fixture": 1, "round": 1, "minutes": 1}]}))], "player_id bigint, payload string")
    before = store.read("player_match_history").count()
    with pytest.raises(tables.IntegrityError):
        jobs.update_summaries(spark, store, docs, AS_OF, level="warn")
    assert store.read("player_match_history").count() == before
    jobs.update_summaries(spark, store, docs, AS_OF, level="warn", orphans="quarantine")
    assert store.read("player_match_history").count() == before
    assert spark.read.parquet(f"{store.root}/_orphans/player_match_history").first()["_fk"] == "player_id->players.id"


def test_gate_misses_a_table_that_is_gone(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "silver"))
    store.init(["players"])
    with pytest.raises(quality.QualityError):
        jobs._gate(spark, store, "hard")


def test_train_save_load_score(spark, tmp_path):
    store = _store(spark, tmp_path)
    path = str(tmp_path / "model")
    mae = jobs.train_xpts(spark, store, path)
    assert mae == mae and mae >= 0
    scored = jobs.compute_scores(spark, store, horizon=2, method="ml", model_path=path)
    assert scored.where(F.col("xpts") < 0).count() == 0 and scored.where(F.col("xpts_app") != 0).count() == 0


def test_missing_model_is_a_clear_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        learn.load_model(spark, str(tmp_path / "nope"))


def test_callers_name_their_period(spark, tmp_path):
    """One squad, asked for by three callers: without a period, with a later one, and with one that has no scores."""
    store = _store(spark, tmp_path)
    jobs.build_xpts(spark, store, AS_OF, level="warn", orphans="quarantine")
    one = _squads(spark, store, ((1, 15),))
    squads = one.unionByName(one.withColumn("squad_id", F.lit(2).cast("bigint"))).unionByName(one.withColumn("squad_id", F.lit(3).cast("bigint")))
    periods = sorted(r[0] for r in store.read("player_expected_points").select("event_id").distinct().collect())
    docs = [(s, json.dumps({"picks": [{"element": r.player_id} for r in one.orderBy("slot").collect()], "entry_history": {"bank": 9}})) for s in (1, 2, 3)]
    sent = spark.createDataFrame([(1, None, None), (2, None, periods[1]), (3, None, 10**6)], "squad_id bigint, bank_million double, event_id bigint")
    answers = jobs.answer_requests(spark, store, spark.createDataFrame(docs, "squad_id bigint, payload string"), sent, 2)
    rows = {r.squad_id: r for r in answers.collect()}
    assert [rows[s].event_id for s in (1, 2, 3)] == [periods[0], periods[1], 10**6]
    body = {s: json.loads(rows[s].document) for s in rows}
    assert [body[s]["event_id"] for s in (1, 2, 3)] == [periods[0], periods[1], 10**6] and body[3]["current_team_xpts"] == 0
    alone = jobs.suggest_transfers(spark, store, squads.where("squad_id = 2"), spark.createDataFrame([(2, 9, periods[1])], "squad_id bigint, bank_tenths bigint, event_id bigint"), 2, "service")
    assert body[2]["current_team_xpts"] == alone.first()["current_team_xpts"]
    # published: a second run of one period leaves the others
    root = str(tmp_path / "documents")
    jobs.publish_documents(answers, root)
    jobs.publish_documents(answers.where("squad_id = 2").withColumn("document", F.lit("{}")), root)
    published = {r.squad_id: (r.event_id, r.document) for r in sq.read_documents(spark, root).collect()}
    assert published == {1: (periods[0], rows[1].document), 2: (periods[1], "{}"), 3: (10**6, rows[3].document)}


def test_a_gate_before_the_write_keeps_the_table(spark, tmp_path):
    store = _store(spark, tmp_path)
    before = store.read("player_match_history").count()
    player = store.read("players").first()["id"]
    docs = spark.createDataFrame([(player, json.dumps({"history": [{"fixture": None, "round": 3, "minutes": 500}]}))], "player_id bigint, payload string")
    with pytest.raises(quality.QualityError):
        jobs.update_summaries(spark, store, docs, AS_OF, gate_first=True)
    assert store.read("player_match_history").count() == before


def test_weighted_vectors_predict_as_single_rows(spark):
    rows = spark.range(400).select(
        "id", (F.col("id") % 4 + 1).cast("int").alias("element_type_id"), (F.col("id") % 5 + 1).cast("int").alias("team_strength"), F.lit(3).alias("opponent_strength"),
        (F.col("id") % 2).cast("int").alias("is_home"), (F.col("id") % 3 + 1).cast("int").alias("difficulty"), (F.col("id") % 6 / 2).alias("form"), F.lit(1.0).alias("points_per_game"),
        F.lit(60.0).alias("minutes_per_game"), F.lit(1).alias("status_available"), (F.col("id") * 7919 % 13).cast("int").alias("total_points"), F.col("id").alias("player_id"), F.lit(1).alias("game_id"))
    fit = learn.train(rows, max_iter=5)
    assert fit.n_train + fit.n_val == 400 and fit.n_vectors == 60
    single = Pipeline(stages=[VectorAssembler(inputCols=learn.FEATURES, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="total_points", maxIter=5, maxDepth=learn.MAX_DEPTH, stepSize=learn.LEARNING_RATE, seed=0)])
    raw = single.fit(rows.where(~learn.in_validation(0.2)))
    a, b = ({r["id"]: r["prediction"] for r in m.transform(rows).collect()} for m in (fit.model, raw))
    assert a == pytest.approx(b, abs=1e-9)


def _games(spark, n, form):
    columns = {c: F.lit(1) for c in learn.FEATURES} | {"difficulty": F.col("id") % 5 + 1, "form": form, "points_per_game": F.lit(1.0), "minutes_per_game": F.lit(60.0)}
    return spark.range(n).select("id", F.col("id").alias("player_id"), F.lit(1).alias("game_id"), *(v.cast("double" if c in ("form", "points_per_game", "minutes_per_game") else "int").alias(c) for c, v in columns.items()), (F.col("id") * 7919 % 13).cast("int").alias("total_points"))


def test_vectors_of_the_fit_fill_whole_waves(spark, monkeypatch):
    """One partition more than the cores would double the time of each of some 500 jobs."""
    assert [learn.fit_partitions(n, 12) for n in (0, 100_000, 100_001, 1_150_000, 60_000_000, 60_000_001)] == [1, 1, 2, 12, 12, 24]
    seen, fit, cores = [], learn.Pipeline.fit, spark.sparkContext.defaultParallelism
    monkeypatch.setattr(learn.Pipeline, "fit", lambda self, df: (seen.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]), fit(self, df))[1])
    monkeypatch.setattr(learn, "ROWS_PER_PARTITION", 50, raising=False)
    found = learn.train(_games(spark, 4000, F.col("id") / 10), max_iter=1)
    assert len(seen[0]) % cores == 0 and sum(seen[0]) == found.n_vectors and max(seen[0]) <= 2 * min(seen[0])
