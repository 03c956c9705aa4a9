"""Every registered query with an oracle matches DuckDB on the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from leagueflow.plans import proof

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(proof.ORACLES))
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())


def test_entry_is_the_flagship_query(spark):
    df = E.entry(spark)
    assert df.columns == ["player_id", "event_id", "xmins", "xpts", "xpts_att", "xpts_def", "xpts_app"]
    assert df.count() == E.queries()["xpts_baseline"](spark, SF).count() > 0


def test_every_query_of_the_reference_has_an_oracle():
    assert set(proof.QUERIES) == set(proof.ORACLES)


@pytest.mark.parametrize("name", ["xpts_baseline", "swaps_cli", "form_last5", "difficulty_lookup", "train_mae"])
def test_results_do_not_depend_on_the_number_of_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            df = E.queries()[name](spark, SF)
            found.append(_rows(df.columns, [tuple(r) for r in df.collect()]))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


@pytest.mark.parametrize("name", ["xpts_baseline", "player_latest", "score_features", "dq_report", "best_xi_capped", "parse_history", "train_features", "upsert_latest"])
def test_building_a_plan_starts_no_job(spark, name):
    group = f"plan-{name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        E.queries()[name](spark, SF)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading a Parquet footer is the only job that a reader may start
    infos = [spark.sparkContext.statusTracker().getJobInfo(j) for j in jobs]
    stages = [spark.sparkContext.statusTracker().getStageInfo(s) for i in infos if i for s in i.stageIds]
    assert all(s is None or s.numTasks <= 1 for s in stages), [s.name for s in stages if s]
