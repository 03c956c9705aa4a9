"""Parsing rules on documents made up for each rule, and the stream against the rows it was fed with."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from leagueflow.plans.roles import role
from leagueflow.sources import payloads
from leagueflow.sources.tables import TableStore
from leagueflow.streaming import ingest

SF = "/root/testdata/sf0.001"


def docs_of(spark, *bodies, **keys):
    names = "".join(f"{k} bigint, " for k in keys)
    return spark.createDataFrame([(*keys.values(), b if isinstance(b, str) else json.dumps(b)) for b in bodies], f"{names}payload string")


def test_numbers_as_text_missing_leaves_and_unknown_fields(spark):
    body = {"elements": [{"id": "9001", "web_name": "Zed", "team": 77, "now_cost": "43", "form": "0.07", "colour": "red"},
                         {"id": 9002, "team": None, "element_type": "2.0", "minutes": "", "selected_by_percent": "n/a", "expected_goals": 1e-2}]}
    a, b = payloads.parse_players(docs_of(spark, body)).orderBy("id").collect()
    assert (a.id, a.team_id, a.now_cost, a.form, a.element_type_id, a.minutes) == (9001, 77, 43, 0.07, None, None)
    assert (b.id, b.team_id, b.element_type_id, b.minutes, b.selected_by_percent, b.expected_goals) == (9002, None, 2, None, None, 0.01)


@pytest.mark.parametrize("body", ["{}", '{"teams": null}', '{"teams": []}', "[1, 2]", "not json", '"text"', ""])
def test_documents_without_the_array_give_no_rows(spark, body):
    assert payloads.parse_teams(docs_of(spark, body)).count() == 0


def test_zone_offsets_become_utc(spark):
    body = {"events": [{"id": 3, "name": "third", "deadline_time": "2031-02-28T23:30:00-05:30", "finished": "false"},
                       {"id": 4, "deadline_time": "2031-03-01", "is_next": 1}, {"id": 5, "deadline_time": "soon", "is_current": "maybe"}]}
    rows = {r.id: r for r in payloads.parse_events(docs_of(spark, body)).collect()}
    assert rows[3].deadline_time == dt.datetime(2031, 3, 1, 5, 0) and rows[3].finished is False
    assert rows[4].deadline_time == dt.datetime(2031, 3, 1) and rows[4].is_next is True
    assert rows[5].deadline_time is None and rows[5].is_current is None


def test_synthetic_keys_come_from_period_and_place(spark):
    body = {"history": [{"round": 12, "minutes": 3}, {"fixture": 501, "round": 12}, {"fixture": "", "round": "13"}, {"minutes": "61"}]}
    rows = payloads.parse_history(docs_of(spark, body, player_id=66), pos="place").orderBy("place").collect()
    assert [r.fixture_id_effective for r in rows] == [-12000, 501, -13002, -3]
    assert [r.fixture_id for r in rows] == [None, 501, None, None] and {r.player_id for r in rows} == {66}


def test_fixture_list_is_the_document(spark):
    body = [{"id": 88, "event": None, "team_h": "5", "team_a": 6, "finished": None, "team_a_difficulty": "1"}]
    r = payloads.parse_fixtures(docs_of(spark, body, "[]", "{}")).collect()
    assert [(x.id, x.event_id, x.team_h, x.finished, x.kickoff_time, x.team_a_difficulty) for x in r] == [(88, None, 5, None, None, 1)]


def test_picks_vice_by_flag_or_zero_multiplier_and_bank(spark):
    body = {"picks": [{"element": 31, "position": 4, "multiplier": 3, "is_captain": True}, {"position": 5},
                      {"element": "32", "is_vice_captain": True, "multiplier": 1}, {"element": 33, "multiplier": "0"}],
            "entry_history": {"bank": "17"}}
    docs = docs_of(spark, body, sq=8)
    assert [p.is_vice_captain for p in payloads.parse_picks(docs, ["sq"]).orderBy("pick_index").collect()] == [False, False, True, True]
    members, bank = payloads.squad_from_picks(docs, ["sq"])
    assert [r.player_id for r in members.orderBy("pick_index").collect()] == [31, 32, 33]
    assert bank.first().bank_million == 1.7
    _, none = payloads.squad_from_picks(docs_of(spark, {"entry_history": {"bank": "1.7"}}, sq=9), ["sq"])
    assert none.first().bank_million == 0.0


def test_id_list(spark):
    df = spark.createDataFrame([(4, " 70,71 ,, 9x,72,")], "k int, s string")
    assert [(r.pos, r.player_id) for r in payloads.parse_id_list(df, "s", ["k"]).collect()] == [(0, 70), (1, 71), (2, None), (3, 72)]


def test_envelope_refuses_what_is_no_object(spark):
    lines = ['{"request_key": "element-summary:5", "payload": {"history": []}}', '{"request_key": "element-summary:6", "payload": "garbage {"}',
             '{"request_key": "element-summary:7", "payload": [1]}', '{"request_key": "teams", "payload": {}}', "no json", '{"request_key": "element-summary:8"}']
    ok = ingest.envelope(spark.createDataFrame([(x,) for x in lines], "value string")).where("ok").collect()
    assert [r.player_id for r in ok] == [5]


def test_stream_stores_every_row_and_replays_change_nothing(spark, tmp_path):
    hist, future = role(spark, SF, "player_match_history"), role(spark, SF, "player_future_fixtures")
    bronze, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    ingest.summary_lines(hist, future).repartition(5).write.text(bronze)
    (tmp_path / "bronze" / "bad.txt").write_text('{"request_key": "element-summary:5", "payload": "garbage {"}\n')
    ingest.ingest_stream(spark, bronze, silver, str(tmp_path / "ck"), files_per_batch=2)
    store = TableStore(spark, silver)
    got = store.read("player_match_history")
    values = ["player_id", "fixture_id", "event_id", "minutes", "total_points", "expected_goals"]
    assert got.count() == hist.count()
    assert sorted(map(tuple, got.select(values).collect()), key=str) == sorted(map(tuple, hist.select(values).collect()), key=str)
    assert store.read("player_future_fixtures").count() == future.count() > 0
    logged = store.read("meta_ingestions").count()
    assert logged == ingest.summary_docs(hist, future).count()
    assert [r.value for r in spark.read.text(f"{silver}/_quarantine").collect()] == ['{"request_key": "element-summary:5", "payload": "garbage {"}']
    # the log of a store that began with the stream survives what a job does first
    store.init()
    assert store.read("meta_ingestions").count() == logged
    # a batch that is processed again writes the same rows and replaces its own part of the log
    lines = spark.read.text(bronze)
    for _ in range(2):
        ingest.process_batch(store, lines, 99)
        assert store.read("player_match_history").count() == hist.count()
        assert store.read("meta_ingestions").count() == 2 * logged


def test_one_bad_element_spoils_its_array_and_a_repeated_key_the_document(spark):
    spoilt = ['{"teams": [{"id": 1}, 5]}', '{"teams": [{"id": 1}, null]}', '{"a": 1, "a": 2, "teams": [{"id": 3}]}']
    assert payloads.parse_teams(docs_of(spark, *spoilt)).count() == 0
    assert [r.id for r in payloads.parse_teams(docs_of(spark, '{"teams": [{"id": 1, "id2": {}}, {}]}')).collect()] == [1, None]


def test_a_document_is_parsed_once_for_all_its_tables(spark):
    body = {"teams": [{"id": 4, "strength": "3"}], "events": [{"id": 5}], "elements": [{"id": 6, "team": 4}], "element_types": [{"id": 7}]}
    docs = payloads.parsed(docs_of(spark, body)).persist()
    try:
        for parse, want in ((payloads.parse_teams, 4), (payloads.parse_events, 5), (payloads.parse_players, 6), (payloads.parse_positions, 7)):
            rows = parse(docs)
            assert [r.id for r in rows.collect()] == [want]
            above = rows._jdf.queryExecution().optimizedPlan().toString()
            assert "parse_json" not in above.split("InMemoryRelation")[0]
    finally:
        docs.unpersist()
    good = ingest.ordered(ingest.envelope(spark.createDataFrame([('{"request_key": "element-summary:5", "payload": {"history": []}}',)], "value string")).where("ok"))
    assert good._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 2  # the filter, and the document that everything else reads


def test_a_long_stream_leaves_few_deltas(spark, tmp_path):
    """Batches of one file each: no bucket has more folders than stated, and every row is there."""
    bronze, silver = tmp_path / "bronze", str(tmp_path / "silver")
    bronze.mkdir()
    for k in range(12):
        line = {"request_key": f"element-summary:{k % 3}", "fetched_at_utc": f"2024-01-01T00:00:{k:02d}Z", "payload": {"history": [{"fixture": k % 10, "minutes": k}]}}
        (bronze / f"f{k:02d}.txt").write_text(json.dumps(line) + "\n")
    store = TableStore(spark, silver, buckets=2)
    store.init(["player_match_history", "last_fetches"])
    ingest.ingest_stream(spark, str(bronze), silver, str(tmp_path / "ck"), files_per_batch=1, most_deltas=3)
    assert len(store._complete("meta_ingestions")) == 12
    for table in ("player_match_history", "last_fetches"):
        assert all(len(p) <= 3 for p in store._bucket_folders(table).values())
    want = {}
    for k in range(12):
        want[k % 3, k % 10] = k
    assert {(r.player_id, r.fixture_id): r.minutes for r in store.read("player_match_history").collect()} == want
    assert {r.request_key: r.last_fetched.second for r in store.read("last_fetches").collect()} == {"element-summary:0": 9, "element-summary:1": 10, "element-summary:2": 11}


def test_bronze_files_are_pruned_and_named(spark, tmp_path):
    root = str(tmp_path / "bronze")
    fetches = spark.range(40).select((F.when(F.col("id") % 2 == 0, F.lit("element-summary")).otherwise(F.lit("fixtures"))).alias("endpoint"),
                                     F.concat(F.lit("element-summary:"), F.col("id").cast("string")).alias("request_key"),
                                     F.expr("timestamp_ntz'2024-03-01 12:00:00' + make_interval(0, 0, 0, cast(id % 4 as int))").alias("fetched_at_utc"), F.lit("{}").alias("payload"))
    payloads.write_bronze(fetches, root)
    lines = payloads.read_bronze(spark, root, "element-summary", "2024-03-02", "2024-03-03")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "fetch_date" in plan.split("PartitionFilters")[1]
    rows = ingest.envelope(lines).collect()
    assert sorted(r.player_id for r in rows) == [i for i in range(40) if i % 4 == 2]
    assert all("/endpoint=element-summary/fetch_date=2024-03-03/" in r.payload_path and r.url is None for r in rows)
    # a root without partition folders, as a stream of plain files has it
    assert all(r.payload_path for r in payloads._with_file(spark.read.text(f"{root}/endpoint=fixtures/fetch_date=2024-03-02")).collect())


def test_a_generator_reads_its_array_once(spark):
    """The array is made below the generator, which would evaluate it for each use."""
    rows = payloads.parse_history(payloads.parsed(docs_of(spark, {"history": [{"fixture": 4, "minutes": "12.9"}]}, player_id=3)))
    above = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate posexplode" in x]
    assert above and not any("variant_get" in x.lower() for x in above)
    assert [(r.player_id, r.fixture_id, r.minutes) for r in rows.collect()] == [(3, 4, 12)]
