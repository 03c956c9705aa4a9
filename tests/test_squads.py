import random
from collections import defaultdict

import pytest

import squad_bruteforce as bf
from leagueflow.operators import squads as sq


def _world(spark, seed, n_squads=40, pool=120, scores_neg=False, teams=6, coarse=False):
    rnd = random.Random(seed)
    players = []
    for pid in range(1, pool + 1):
        players.append((pid, f"p{pid}", rnd.choice([1, 2, 2, 3, 3, 4]), rnd.randrange(teams), rnd.randrange(40, 131)))
    by_role = defaultdict(list)
    for p in players:
        by_role[p[2]].append(p[0])
    squads, bank = [], []
    for s in range(n_squads):
        ids = rnd.sample(by_role[1], 2) + rnd.sample(by_role[2], 5) + rnd.sample(by_role[3], 5) + rnd.sample(by_role[4], 3)
        rnd.shuffle(ids)
        squads += [(s, pid, i + 1) for i, pid in enumerate(ids)]
        bank.append((s, 1, rnd.randrange(0, 30)))
    lo = -300 if scores_neg else 0
    scores = [(pid, 1, rnd.randrange(4) / 2 if coarse else rnd.randrange(lo, 900) / 100) for pid in range(1, pool + 1) if rnd.random() < 0.9]
    return players, squads, bank, scores


def _check(spark, world, presets, top_n):
    players, squads, bank, scores = world
    P = spark.createDataFrame(players, "id bigint, web_name string, element_type_id bigint, team_id bigint, now_cost bigint")
    S = spark.createDataFrame(squads, "squad_id bigint, player_id bigint, slot int")
    R = spark.createDataFrame(bank, "squad_id bigint, event_id bigint, bank_tenths bigint")
    X = spark.createDataFrame(scores, "player_id bigint, event_id bigint, xpts double")
    info = {p[0]: dict(id=p[0], role=p[2], team=p[3], cost=p[4]) for p in players}
    cents = {pid: round(x * 100) for pid, _, x in scores}
    members = defaultdict(list)
    for s, pid, slot in squads:
        members[s].append(dict(info[pid], slot=slot))
    banks = {s: b for s, _, b in bank}
    for preset in presets:
        got = defaultdict(list)
        for r in sq.swap_suggestions(S, P, X, R, preset, top_n).orderBy("squad_id", "rank").collect():
            got[r.squad_id].append((r.out_player_id, r.in_player_id, round(r.team_xpts_delta * 100), round(r.new_team_xpts * 100)))
        eleven = {r.squad_id: r for r in sq.best_eleven(S, P, X, R, preset).collect()}
        for s, mem in members.items():
            solve = bf.eleven_capped if preset == "cli" else bf.eleven_uncapped
            score = lambda m: cents.get(m["id"], 0)
            assert round(eleven[s].team_xpts * 100) == solve(mem, score), (preset, s)
            if eleven[s].team_xpts > 0:
                assert sum(cents.get(i, 0) for i in eleven[s].xi) == solve(mem, score) and len(set(eleven[s].xi)) == len(eleven[s].xi)
            _, exp = bf.swaps(mem, list(info.values()), cents, banks[s], preset, top_n)
            assert got[s] == exp, (preset, s)


@pytest.mark.parametrize("seed,neg", [(1, False), (2, False), (3, True)])
def test_swaps_match_brute_force(spark, seed, neg):
    _check(spark, _world(spark, seed, scores_neg=neg), ("cli", "service"), 10)


@pytest.mark.parametrize("seed,preset,top_n,coarse", [(4, "cli", 1, True), (5, "service", 1, False), (6, "service", 50, True), (7, "cli", 4, False)])
def test_short_lists_lose_no_swap(spark, seed, preset, top_n, coarse):
    """Many more buyers than a short list holds, with ties; few teams, so that squads have full teams."""
    world = _world(spark, seed, n_squads=3, pool=1600, teams=5, coarse=coarse)
    _check(spark, world, (preset,), top_n)


def test_a_seller_meets_a_bounded_number_of_buyers(spark):
    """The short lists have the same size for 5,000 and for 20,000 buyers."""
    from pyspark.sql import functions as F

    sizes = []
    for n in (5000, 20000):
        ids = spark.range(n).withColumn("h", F.abs(F.xxhash64("id")))
        buyers = ids.select(F.col("id").alias("c_id"), F.lit(2).cast("bigint").alias("c_role"), (F.col("h") % 20).alias("c_team"),
                            (40 + F.col("h") % 31).alias("c_cost"), F.lit(1).cast("bigint").alias("c_event"), (F.col("h") % 900).alias("x"))
        sellers = spark.createDataFrame([(1, 2, 55), (1, 2, 90)], "event_id bigint, o_role bigint, price_limit bigint")
        sizes.append(sq.short_lists(buyers, sellers, 10, 15).groupBy("price_limit").count().agg(F.max("count")).first()[0])
    assert max(sizes) <= 2 * 6 * 25


@pytest.mark.parametrize("asked,given", [(0, 1), (-3, 1), (99, 50)])
def test_the_service_answers_with_1_to_50_suggestions(spark, asked, given):
    players, squads, bank, scores = _world(spark, 9, n_squads=1, pool=400, teams=40)
    P = spark.createDataFrame(players, "id bigint, web_name string, element_type_id bigint, team_id bigint, now_cost bigint")
    S = spark.createDataFrame(squads, "squad_id bigint, player_id bigint, slot int")
    R = spark.createDataFrame([(s, e, 90) for s, e, _ in bank], "squad_id bigint, event_id bigint, bank_tenths bigint")
    X = spark.createDataFrame(scores, "player_id bigint, event_id bigint, xpts double")
    assert sq.service_suggestions(S, P, X, R, asked).count() == given


def test_squads_keep_their_partitions_and_few_buyers_are_evaluated(spark):
    """Costly folds over few bytes: neither the arrays nor the sellers are merged into one task by size."""
    from pyspark.sql import functions as F

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = spark.range(600).select(
        (F.col("id") % 40).alias("squad_id"), F.lit(1).cast("long").alias("event_id"), (1 + F.col("id") % 4).alias("role"), F.col("id").alias("score"),
        F.col("id").cast("int").alias("slot"), (F.col("id") % 5).alias("team"), F.col("id").alias("player_id"), F.lit(50).cast("long").alias("cost"),
    ).repartition(parts, "squad_id", "event_id")
    arrays = sq._squad_arrays(members)
    assert arrays.rdd.getNumPartitions() == parts
    requests = spark.range(40).select(F.col("id").alias("squad_id"), F.lit(1).cast("long").alias("event_id"), F.lit(5).cast("long").alias("bank_tenths"))
    ps = sq.PRESETS["service"]
    assert sq._seller_rows(members, requests, ps, False).rdd.getNumPartitions() == parts


def test_a_seller_keeps_the_first_feasible_buyers_of_both_orders(spark):
    lists = spark.createDataFrame([(1, 2, 60, c, c % 3, 50, (7 * c) % 31) for c in range(30)], "c_event long, c_role long, price_limit long, c_id long, c_team long, c_cost long, x long")
    near = sq._listed(lists).selectExpr("*", "1 AS squad_id", "array(0L, 3L) AS owned", "array(1L) AS blocked")
    got = sorted(r["c_id"] for r in sq._first_feasible(near, 4).collect())
    fit = [c for c in range(30) if c not in (0, 3) and c % 3 != 1]
    assert got == sorted({*fit[:4], *sorted(fit, key=lambda c: (-((7 * c) % 31), c))[:4]})


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_grows_is_not_broadcast_by_its_estimate(spark, tmp_path):
    """Files of a few bytes can hold millions of rows: players, scores, names and members meet by a shuffle of both sides."""
    from pyspark.sql import functions as F

    rows = spark.range(600)
    role = "CASE WHEN id % 15 < 2 THEN 1L WHEN id % 15 < 7 THEN 2L WHEN id % 15 < 12 THEN 3L ELSE 4L END"
    rows.selectExpr("id", "'n' web_name", f"{role} element_type_id", "id % 5 team_id", "50L now_cost").write.parquet(f"{tmp_path}/players")
    rows.selectExpr("id player_id", "1L event_id", "1.5D xpts").write.parquet(f"{tmp_path}/scores")
    rows.selectExpr("id div 15 squad_id", "id player_id", "cast(1 + id % 15 as int) slot").write.parquet(f"{tmp_path}/squads")
    spark.range(40).selectExpr("id squad_id", "1L event_id", "5L bank_tenths").write.parquet(f"{tmp_path}/requests")
    P, X, S, R = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("players", "scores", "squads", "requests"))
    ps = sq.PRESETS["service"]
    sc = sq.requested_scores(X, R)
    members = sq.squad_members(S, P, sc, R, ps)
    found = S.select("squad_id", F.col("player_id").alias("out_player_id"), F.col("player_id").alias("in_player_id"))
    for joined in (members, sq.candidates(P, sc, R, ps), sq.with_names(found, P)):
        assert "SortMergeJoin" in _plan(joined) and "BroadcastHashJoin" not in _plan(joined)
    asked = sq.suggestion_requests(S, R.selectExpr("squad_id", "0.5D bank_million"), R.selectExpr("squad_id", "0.0D bank_million"), X)
    assert "BroadcastHashJoin" not in _plan(asked)
    assert members.count() == 600 and asked.where("status = 'ok' AND bank_tenths = 5").count() == 40
    # all sellers rise: no buyer is sent to the salts of the others
    assert "_bsalt" not in _plan(sq.swap_suggestions(S, P, X, R, "service", 3))


def test_parts_of_squads_are_not_broadcast(spark, tmp_path):
    from leagueflow.plans.roles import role

    spark.range(200).selectExpr("id % 7 l_suppkey", "id % 50 l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).selectExpr("id p_partkey", "cast(id as int) p_size").write.parquet(f"{tmp_path}/part.parquet")
    squads = role(spark, str(tmp_path), "squads")
    assert "ShuffledHashJoin" in _plan(squads) and "BroadcastHashJoin" not in _plan(squads)
    assert squads.count() == 7 * 15
