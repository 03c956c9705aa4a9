import datetime as dt

import pytest
from pyspark.sql import functions as F

from leagueflow.functions.casts import round2, safe_float, safe_int, safe_ts_utc
from leagueflow.functions.keys import key_id, request_key
from leagueflow.functions.scoring import difficulty_multiplier, expected_minutes, point_components


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_difficulty_multiplier(spark):
    """Falls from 1 to 5; whatever is no difficulty is neutral."""
    got = one(spark, difficulty_multiplier("d"), [(k,) for k in (5, 4, 3, 2, 1)], "d int")
    assert got == sorted(got) and got[2] == 1.0 and len(set(got)) == 5
    assert one(spark, difficulty_multiplier("d"), [(-1,), (17,), (None,)], "d int") == [1.0] * 3


@pytest.mark.parametrize(
    "games,mins,season,finished,status,expected",
    [(4, 331, 7, 9, "a", 82.75), (3, 400, 0, 1, "A", 90.0), (2, 180, 511, 7, "a", 73.0), (None, None, 2000, 0, "u", 36.0),
     (7, None, 77, 7, "s ", 4.4), (5, -50, 0, 0, "a", 0.0), (3, 135, 0, 0, None, 45.0)],
)
def test_expected_minutes(spark, games, mins, season, finished, status, expected):
    df = spark.createDataFrame([(games, mins, season, finished, status)], "g int, m int, s int, f int, st string")
    assert df.select(expected_minutes("g", "m", "s", "f", "st")).first()[0] == pytest.approx(expected)


def test_point_components(spark):
    """Half a game of a defender by his rate, two thirds of a midfielder's by his average, and a forward who does not play."""
    rows = [(45.0, 200, 31, None, 2, 1.15), (60.0, 0, 9, 7.25, 3, 0.85), (0.0, 90, 40, None, 4, 1.0)]
    df = spark.createDataFrame(rows, "x double, m int, p int, ppg double, e int, mult double")
    c = point_components("x", "m", "p", "ppg", "e", "mult")
    got = df.select(*[round2(c[k]).alias(k) for k in ("xpts_app", "xpts_att", "xpts_def", "xpts")]).collect()
    assert [tuple(r) for r in got] == [(1.5, 2.75, 4.12, 8.37), (1.67, 2.08, 0.89, 4.64), (0.0, 0.0, 0.0, 0.0)]


def test_safe_casts(spark):
    vals = [("12.9",), ("-1.5",), (" 7 ",), ("nan",), ("",), ("abc",), ("1e3",), ("1_000",), ("1.0d",), (None,)]
    assert one(spark, safe_int("v"), vals, "v string") == [12, -1, 7, None, None, None, 1000, None, None, None]
    f = one(spark, safe_float("v"), vals, "v string")
    assert f[0] == 12.9 and f[2] == 7.0 and f[3] != f[3] and f[4] is None and f[7] is None and f[8] is None


def test_safe_timestamps_are_utc(spark):
    vals = [("2033-12-31T22:15:00Z",), ("2033-12-31T22:15:00-03:00",), ("2033-12-31 22:15:00",), ("bad",)]
    got = one(spark, safe_ts_utc("v"), vals, "v string")
    assert got == [dt.datetime(2033, 12, 31, 22, 15), dt.datetime(2034, 1, 1, 1, 15), dt.datetime(2033, 12, 31, 22, 15), None]


def test_request_keys(spark):
    base = "https://x.example/api/"
    urls = [
        (base + "bootstrap-static/",), (base + "fixtures/",), (base + "element-summary/42/",),
        (base + "entry/7/event/25/picks/",), (base + "entry/7/history/",), (base + "other/a/b/",), ("no/base/url/",),
    ]
    ep, key = request_key(F.col("u"), base)
    got = [tuple(r) for r in spark.createDataFrame(urls, "u string").select(ep, key).collect()]
    assert got == [
        ("bootstrap-static", "bootstrap-static"), ("fixtures", "fixtures"), ("element-summary", "element-summary:42"),
        ("entry", "entry:7:25"), ("entry", "entry:7:history"), ("other", "other:a:b"), ("no", "no:base:url:"),
    ]
    ids = one(spark, key_id("k"), [("element-summary:5",), ("element-summary:x",), ("entry:1:2",)], "k string")
    assert ids == [5, None, None]


@pytest.mark.parametrize("text,want", [
    ("9007199254740993", 9007199254740993), ("-9223372036854775808", -9223372036854775808), ("9223372036854775808", None), (" +17 ", 17),
    ("7.999", 7), ("-7.999", -7), ("2.5e2", 250), ("1e400", None), ("0x10", None), ("--3", None), ("", None),
])
def test_integers_keep_their_value(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(safe_int("s")).first()[0] == want


def test_times_do_not_depend_on_the_session_zone(spark):
    cases = {"2031-07-04": dt.datetime(2031, 7, 4), "2031-07-04T05:06:07": dt.datetime(2031, 7, 4, 5, 6, 7), "2031-07-04T05:06:07Z": dt.datetime(2031, 7, 4, 5, 6, 7),
             "2031-07-04T05:06:07+09:30": dt.datetime(2031, 7, 3, 19, 36, 7), "2031-07-04 05:06-02": dt.datetime(2031, 7, 4, 7, 6), "2031-07-04T05:06:07.5+0100": dt.datetime(2031, 7, 4, 4, 6, 7, 500000), "noon": None, "2031-13-04": None}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", safe_ts_utc("s").alias("t")).collect()
            assert {r.s: r.t for r in rows} == cases, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_bank_rounds_half_to_even(spark):
    from leagueflow.operators import squads

    banks = [(1, 0.25, 2), (2, 0.35, 4), (3, 1.25, 12), (4, 1.75, 18), (5, 2.04, 20)]
    members = spark.createDataFrame([(b[0], 1) for b in banks], "squad_id bigint, player_id bigint")
    api = spark.createDataFrame([(b[0], b[1]) for b in banks], "squad_id bigint, bank_million double")
    scores = spark.createDataFrame([(1, 1, 1.0)], "player_id bigint, event_id bigint, xpts double")
    got = squads.suggestion_requests(members, api, api, scores).collect()
    assert {r.squad_id: r.bank_tenths for r in got} == {b[0]: b[2] for b in banks}


@pytest.mark.parametrize("x,want", [(0.125, 0.13), (0.375, 0.38), (-0.125, -0.12), (3.14159, 3.14), (7.0, 7.0)])
def test_round2_takes_halves_up(spark, x, want):
    assert spark.createDataFrame([(x,)], "x double").select(round2("x")).first()[0] == want
