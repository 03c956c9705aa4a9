import datetime as dt

from leagueflow.operators import marts, scoring


def test_form_of_fewer_games_than_asked(spark):
    hist = spark.createDataFrame([(70, 11, 4, 17, -1), (70, 12, 5, 64, 3), (70, -5002, 5, 90, 11)],
                                 "player_id bigint, fixture_id_effective bigint, event_id bigint, minutes int, total_points int")
    fx = spark.createDataFrame([(11, dt.datetime(2031, 5, 1)), (12, None)], "id bigint, kickoff_time timestamp_ntz")
    row = marts.last_n_form(hist, fx).first()
    assert (row.games_last5, row.minutes_last5, row.points_last5) == (3, 171, 13) and abs(row.ppg_last5 - 13 / 3) < 1e-12
    assert marts.last_n_form(hist, fx, n=2).first().points_last2 == -1 + 3  # dated first; then the larger key of period 5


def test_form_keeps_newest_five_and_undated_last(spark):
    rows = [(1, i, i, 90, i) for i in range(1, 8)] + [(1, 100, 99, 90, 50)]
    hist = spark.createDataFrame(rows, "player_id bigint, fixture_id_effective bigint, event_id bigint, minutes int, total_points int")
    fx = spark.createDataFrame([(i, dt.datetime(2025, 1, i)) for i in range(1, 8)] + [(100, None)], "id bigint, kickoff_time timestamp_ntz")
    row = marts.last_n_form(hist, fx).first()
    assert row.points_last5 == 3 + 4 + 5 + 6 + 7  # the undated game ranks last


def test_baseline_of_an_injured_away_defender(spark):
    players = spark.createDataFrame([(51, 8, 2, 260, 4.4, "i"), (52, None, 2, 260, 4.4, "a")],
                                    "id bigint, team_id bigint, element_type_id bigint, minutes int, points_per_game double, status string")
    fixtures = spark.createDataFrame([(9, 6, 3, 8, None, 5, 1), (10, 2, 8, 3, True, 1, 1)],
                                     "id bigint, event_id bigint, team_h bigint, team_a bigint, finished boolean, team_h_difficulty int, team_a_difficulty int")
    events = spark.createDataFrame([(k, k < 5) for k in range(1, 7)], "id bigint, finished boolean")
    form = spark.createDataFrame([], "player_id bigint, games_last5 bigint, minutes_last5 bigint, points_last5 bigint, ppg_last5 double")
    rows = scoring.baseline_scores(players, form, fixtures, events, horizon=2).collect()
    assert [(r.player_id, r.event_id) for r in rows] == [(51, 6)]
    # 260 minutes over 4 finished periods, 0.4 of them; (4.4 - 2) x 26/90 x 1.15 on top of 1 + 26/90
    assert (rows[0].xmins, rows[0].xpts_app, rows[0].xpts) == (26.0, 1.29, 2.09)
