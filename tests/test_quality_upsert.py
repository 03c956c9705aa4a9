import pytest
from pyspark.sql import functions as F

from leagueflow.operators import quality
from leagueflow.sources import tables


def _tables(spark, n_players=601, n_fixtures=350, minutes=90):
    t = {
        "teams": spark.createDataFrame([(1, 4)], "id bigint, strength int"),
        "element_types": spark.createDataFrame([(1,)], "id bigint"),
        "events": spark.createDataFrame([(1, True)], "id bigint, finished boolean"),
        "players": spark.range(n_players).select(F.col("id"), F.lit(1).cast("bigint").alias("team_id")),
        "fixtures": spark.range(n_fixtures).select(F.col("id"), F.lit(1).cast("bigint").alias("event_id")),
        "player_match_history": spark.createDataFrame([(1, 1, minutes, 5)], "player_id bigint, fixture_id_effective bigint, minutes int, total_points int"),
        "player_future_fixtures": spark.createDataFrame([(1, 1)], "player_id bigint, fixture_id bigint"),
        "player_expected_points": spark.createDataFrame([(1, 2, 3.0)], "player_id bigint, event_id bigint, xpts double"),
    }
    return t


def test_gate_passes_on_clean_tables(spark):
    g = quality.gate(quality.quality_report(spark, _tables(spark)), "strict").first()
    assert (g.errors, g.warnings, g.should_fail) == (0, 0, False)


def test_minutes_out_of_range_is_hard(spark):
    rep = quality.quality_report(spark, _tables(spark, minutes=150))
    assert quality.gate(rep, "hard").first().should_fail
    assert not quality.gate(rep, "warn").first().should_fail


def test_row_count_warning_only_fails_strict(spark):
    t = _tables(spark, n_players=1, n_fixtures=1)
    rep = quality.quality_report(spark, t)
    assert not quality.gate(rep, "hard").first().should_fail
    assert quality.gate(rep, "strict").first().should_fail


def test_missing_table_is_hard(spark):
    t = _tables(spark)
    del t["player_expected_points"]
    assert quality.gate(quality.quality_report(spark, t), "hard").first().should_fail


def test_upsert_replaces_and_keeps(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    source = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id bigint, v string, o int")
    out = sorted(tuple(r) for r in tables.upsert(target, source, ["id"], ["o"]).collect())
    assert out == [(1, "a"), (2, "y"), (3, "z")]


TEAM = "id bigint, name string, short_name string, strength int"


def test_store_upsert_is_idempotent(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path / "silver"))
    rows = spark.createDataFrame([(1, "A", "AAA", 4)], TEAM)
    for _ in range(2):
        assert store.upsert("teams", rows, ["id"], as_of="2024-01-01 00:00:00") == 1
    got = store.read("teams").collect()
    assert len(got) == 1 and got[0].name == "A"
    assert store.upsert("teams", rows.limit(0), ["id"]) == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_the_last_row_of_a_batch_wins_in_any_layout(spark, tmp_path, partitions):
    store = tables.TableStore(spark, str(tmp_path / "silver"))
    rows = [(i % 7, f"n{k}", "S", k, k) for k, i in enumerate(range(70))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        store.upsert("teams", spark.createDataFrame(rows, TEAM + ", pos int").repartition(5), ["pos"])
        assert sorted((r.id, r.strength) for r in store.read("teams").collect()) == [(i, 63 + i) for i in range(7)]
        # equal order values: the row itself decides, not the layout
        ties = [(1, "b", "S", 1, 0), (1, "a", "S", 9, 0)]
        store.upsert("teams", spark.createDataFrame(ties, TEAM + ", pos int").repartition(2), ["pos"])
        assert store.read("teams").where("id = 1").first().name == "b"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_an_upsert_writes_its_own_buckets_only_and_compaction_changes_no_row(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path / "silver"))
    store.upsert("teams", spark.createDataFrame([(i, f"t{i}", "S", 1) for i in range(200)], TEAM), ["id"])
    whole = {b: len(p) for b, p in store._bucket_folders("teams").items()}
    assert len(whole) == store.buckets
    for k in range(3):
        store.upsert("teams", spark.createDataFrame([(5, f"new{k}", "S", k)], TEAM), ["id"])
    after = {b: p for b, p in store._bucket_folders("teams").items()}
    touched = [b for b in after if len(after[b]) != whole[b]]
    assert len(touched) == 1 and len(after[touched[0]]) == 4
    rows = sorted(map(tuple, store.read("teams").collect()))
    assert (5, "new2", "S", 2, None) in rows and len(rows) == 200
    assert store.compact("teams", most_deltas=3) == touched
    assert len(store._bucket_folders("teams")[touched[0]]) == 1
    assert sorted(map(tuple, store.read("teams").collect())) == rows
    store.upsert("teams", spark.createDataFrame([(5, "newest", "S", 9)], TEAM), ["id"])
    assert store.read("teams").where("id = 5").first().name == "newest"


def test_init_leaves_the_log_alone(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path / "silver"))
    log = spark.createDataFrame([("element-summary:1",), ("element-summary:2",)], "request_key string")
    store.append("meta_ingestions", log, part="a")
    store.init()
    store.append("meta_ingestions", log, part="b")
    store.append("meta_ingestions", log, part="b")
    store.init()
    assert store.read("meta_ingestions").count() == 4


def test_unfinished_folders_do_not_count(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path / "silver"))
    store.upsert("teams", spark.createDataFrame([(1, "A", "AAA", 4)], TEAM), ["id"])
    broken = tmp_path / "silver" / "teams" / "delta=0000000009-00000000" / "_bucket=0"
    broken.mkdir(parents=True)
    (broken / "part.parquet").write_bytes(b"cut off")
    assert store.read("teams").count() == 1


def test_fk_guard_rejects_orphans(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path / "silver"))
    store.upsert("teams", spark.createDataFrame([(1, "A", "AAA", 4)], TEAM), ["id"])
    bad = spark.createDataFrame([(10, 2), (11, 1)], "id bigint, team_id bigint")
    with pytest.raises(tables.IntegrityError):
        store.upsert("players", bad, ["id"])
    assert store.read("players").count() == 0
    assert store.upsert("players", bad, ["id"], orphans="quarantine") == 2
    assert [r.id for r in store.read("players").collect()] == [11]


def test_the_number_of_buckets_belongs_to_the_table(spark, tmp_path):
    """Opened with another number, upserted and compacted: every row stays."""
    root = str(tmp_path / "silver")
    first = tables.TableStore(spark, root, buckets=8)
    first.upsert("teams", spark.createDataFrame([(i, f"t{i}", "S", 1) for i in range(200)], TEAM), ["id"])
    other = tables.TableStore(spark, root, buckets=16)
    other.upsert("teams", spark.createDataFrame([(i, "new", "S", 2) for i in range(0, 200, 3)], TEAM), ["id"])
    assert other.compact("teams", most_deltas=1)
    rows = {r.id: r.name for r in tables.TableStore(spark, root, buckets=4).read("teams").collect()}
    assert rows == {i: "new" if i % 3 == 0 else f"t{i}" for i in range(200)}
    assert set(first._bucket_folders("teams")) <= set(range(8))


def test_a_table_of_another_shape_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "silver")
    tables.TableStore(spark, root).init(["teams"])
    monkeypatch.setitem(tables.KEYS, "teams", ["name"])
    with pytest.raises(tables.DescriptorError):
        tables.TableStore(spark, root).init(["teams"])
    monkeypatch.undo()
    store = tables.TableStore(spark, root)
    store.upsert("teams", spark.createDataFrame([(1, "A", "AAA", 4)], TEAM), ["id"])
    (tmp_path / "silver" / "teams" / "_descriptor").unlink()
    with pytest.raises(tables.DescriptorError):
        tables.TableStore(spark, root).compact("teams", most_deltas=0)


def test_superseded_folders_go_when_asked(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path / "silver"), buckets=2)
    for k in range(4):
        store.upsert("teams", spark.createDataFrame([(i, f"n{k}", "S", k) for i in range(20)], TEAM), ["id"])
    before = sorted(map(tuple, store.read("teams").collect()))
    assert store.remove_superseded("teams") == 0
    assert store.compact("teams", most_deltas=3) == [0, 1]
    assert store.remove_superseded("teams") == 8
    assert sorted(map(tuple, store.read("teams").collect())) == before
    assert {b: len(p) for b, p in store._held("teams").items()} == {0: 1, 1: 1}


def test_last_fetches_equal_the_aggregate_and_replays_change_nothing(spark, tmp_path):
    from leagueflow.operators import incremental

    store = tables.TableStore(spark, str(tmp_path / "silver"))
    log = spark.range(60).select(F.concat(F.lit("element-summary:"), (F.col("id") % 7).cast("string")).alias("request_key"), F.lit("e").alias("endpoint"),
                                 F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id * 37 % 60 as int))").alias("fetched_at_utc"))
    parts = [log.where(f"hash(fetched_at_utc) % 3 = {k}") for k in (-2, -1, 0, 1, 2)]
    for k in (4, 0, 2, 1, 3, 0, 4):
        store.log_fetches(parts[k], part=f"p{k}")
    want = {tuple(r) for r in log.groupBy("request_key").agg(F.max("fetched_at_utc")).collect()}
    assert {(r.request_key, r.last_fetched) for r in store.read("last_fetches").collect()} == want
    both = [incremental.last_fetch(store.read(t)).orderBy("player_id").collect() for t in ("last_fetches", "meta_ingestions")]
    assert both[0] == both[1] and len(both[0]) == 7
    assert store.read("meta_ingestions").count() == 60


def test_a_batch_that_fails_the_gate_does_not_count(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path / "silver"))
    hist = "player_id bigint, fixture_id_effective bigint, minutes int, total_points int"
    good = spark.createDataFrame([(1, 1, 90, 5), (2, 1, 10, 99)], hist)
    bad = spark.createDataFrame([(1, 1, 131, 5), (3, 1, 1, 1)], hist)
    gate = quality.BatchGate(spark, "hard")
    store.upsert("player_match_history", good, ["player_id"], check=gate)
    with pytest.raises(quality.QualityError):
        store.upsert("player_match_history", bad, ["player_id"], check=gate)
    assert sorted((r.player_id, r.minutes) for r in store.read("player_match_history").collect()) == [(1, 90), (2, 10)]
    assert [r.n for r in gate.reports["player_match_history"].where("check = 'minutes_range'").collect()] == [1]
    assert len(store._match("player_match_history/delta=*")) == 1
    with pytest.raises(quality.QualityError):  # a warning fails a strict gate
        store.upsert("player_match_history", good, ["player_id"], check=quality.BatchGate(spark, "strict"))
    store.upsert("player_match_history", bad, ["player_id"], check=quality.BatchGate(spark, "warn"))
    assert store.read("player_match_history").count() == 3


def test_an_upsert_keeps_no_copy_of_its_input(spark, tmp_path, monkeypatch):
    """An input of one partition is not held whole by the task that reads it: what is kept has gone through the shuffle by key."""
    from pyspark.sql import DataFrame

    kept, real = [], DataFrame.persist

    def persist(df, *a):
        kept.append(df.columns)
        return real(df, *a)

    monkeypatch.setattr(DataFrame, "persist", persist)
    rows = spark.range(50).selectExpr("id % 20 AS id", "cast(id AS string) AS name", "cast(id AS int) AS strength").coalesce(1)
    store = tables.TableStore(spark, str(tmp_path))
    assert store.upsert("teams", rows, ["strength"], orphans="ignore") == 50
    assert kept == []
    players = spark.range(30).selectExpr("id % 10 AS id", "cast(id AS int) AS minutes", "id % 25 AS team_id").coalesce(1)
    assert store.upsert("players", players, ["minutes"], orphans="quarantine") == 30
    assert all("_tie" not in c for c in kept)
    assert {(r["id"], r["minutes"]) for r in store.read("players").collect()} == {(i, 20 + i) for i in range(10) if (20 + i) % 25 < 20}


def test_an_upsert_reads_its_input_once_and_writes_one_file_per_bucket(spark, tmp_path):
    """Rows of one bucket come from many tasks; orphans of all of them are set aside."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    store = tables.TableStore(spark, str(tmp_path / "store"), buckets=3)
    store.upsert("players", spark.range(400).where("id % 5 <> 0"), ["id"], orphans="ignore")
    rows = spark.range(2000).selectExpr("id % 400 as player_id", "id % 500 as fixture_id_effective", "cast(id as int) as minutes").repartition(7)
    assert store.upsert("player_match_history", rows.mapInArrow(counted, rows.schema), ["minutes"], orphans="quarantine") == 2000
    assert read.value == 2000
    files = list((tmp_path / "store" / "player_match_history").glob("delta=*/_bucket=*/*.parquet"))
    assert len(files) == 3
    kept = store.read("player_match_history")
    assert kept.count() == kept.where("player_id % 5 <> 0").count() == 1600
    assert spark.read.parquet(str(tmp_path / "store" / "_orphans" / "player_match_history")).count() == 400
    # a player stored twice is one parent
    store.upsert("players", spark.range(7).where("id % 5 <> 0"), ["id"], orphans="ignore")
    assert store.upsert("player_match_history", rows.where("player_id % 5 <> 0"), ["minutes"]) == 1600
    assert store.read("player_match_history").count() == 1600
    assert store.upsert("player_match_history", rows.where("false"), ["minutes"], orphans="quarantine") == 0
