"""Best line-up and best one-for-one swaps for many squads at once.

Two rule sets (``PRESETS``) cover the two engines of the source system:

* ``"cli"`` – 7 formations, at most 3 players of one team in the eleven
  (greedy: best first, position by position), buyer must have a score row,
  player info needs cost, position and team; result floored at 0.
* ``"service"`` – the 8 formations with 3–5 DEF, 2–5 MID, 1–3 FWD; no team
  cap inside the eleven; goalkeeper optional; buyer without a score counts 0;
  a fallback 1-3-4-3 of whatever exists when nothing is feasible.

Set-based plan (no per-swap re-solve, no Python):

1. members: squads ⋈ player info ⋈ scores of the requested period (≤ 15 rows
   per squad, a bounded group by the game's rules), gathered into one array
   per squad in greedy order.
2. per (squad, seller, formation) two greedy elevens of the 14 others: **A**
   with one slot fewer in the seller's position, **B** with the full quota,
   remembering B's last pick in that position (``kth``). Where the team cap
   cannot bind they are sums of the best of each role, read off prefix sums;
   only for squads with more members of a team than the cap allows they are
   folds (``aggregate``). A buyer
   that sorts before ``kth`` takes the seller's slot: total = A + x; otherwise
   total = B. This holds with the team cap too, because the swap rule only
   admits a buyer whose team has room, so the buyer never blocks or is blocked.
3. short lists. As a function of the buyer's score x a seller's total is flat
   and then strictly rising (``A + t >= B`` in every formation). Ranking is by
   total, then buyer id, so a seller's best ``top_n`` swaps are among its first
   ``top_n`` feasible buyers by (score desc, id) or by id. Feasibility depends
   on the price limit, on the ≤ m ids owned and on the ≤ m/3 teams that are
   full (m: squad size). With K = top_n + m, a buyer with K cheap enough
   buyers of its own team before it can go, and of the rest the first
   (m/3 + 1)·K suffice. These lists exist once per (period, position, price
   limit), in both orders, as two arrays. A seller meets its two arrays in one
   row, keeps the first ``top_n`` feasible buyers of each and is evaluated for
   these alone: at most 2 * ``top_n`` rows a seller are made and sorted.
4. sellers whose total could fall as x rises (rare) meet all buyers.
5. ``row_number() <= top_n`` per squad.

Scores are carried as integer hundredths so sums, deltas and ties are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leagueflow.functions.casts import round2
from leagueflow.session import BROADCAST_MAX_BYTES, cut_lineage, keyed

MAX_PER_TEAM = 3
# Formations (GK, DEF, MID, FWD) of the capped rule set, in try order.
CLI_FORMATIONS = [(1, 3, 5, 2), (1, 3, 4, 3), (1, 4, 5, 1), (1, 4, 4, 2), (1, 4, 3, 3), (1, 5, 4, 1), (1, 5, 3, 2)]
# The service rule set's outfield ranges (DEF, MID, FWD summing to 10).
SERVICE_DEF, SERVICE_MID, SERVICE_FWD = (3, 4, 5), (2, 3, 4, 5), (1, 2, 3)
SERVICE_FALLBACK = (1, 3, 4, 3)
ROLES = (1, 2, 3, 4)


@dataclass(frozen=True)
class Preset:
    formations: tuple
    cap: int | None  # team cap inside the eleven
    require_gk: bool
    require_score: bool  # buyer must have a score row for the period
    full_info: bool  # info needs cost, position and team (else cost only)
    same_team_ok: bool  # a same-team swap is always allowed
    floor_zero: bool  # result = max(0, best); else fallback when nothing > -1
    fallback: tuple | None


PRESETS = {
    "cli": Preset(tuple(CLI_FORMATIONS), MAX_PER_TEAM, True, True, True, False, True, None),
    "service": Preset(
        tuple((1, d, m, f) for d in SERVICE_DEF for m in SERVICE_MID for f in SERVICE_FWD if d + m + f == 10),
        None,
        False,
        False,
        False,
        True,
        False,
        SERVICE_FALLBACK,
    ),
}

_NONE = -100  # "total > -1.0" in hundredths
_NO_KTH = -(1 << 62)  # threshold when B has no kth pick: every buyer sorts before it


def to_cents(c):
    return F.round(c * F.lit(100.0)).cast("bigint")


def player_info(players: DataFrame, preset: Preset) -> DataFrame:
    """id, role, team, cost, name of players usable by the rule set."""
    p = players.where(F.col("now_cost").isNotNull())
    if preset.full_info:
        p = p.where(F.col("element_type_id").isNotNull() & F.col("team_id").isNotNull())
    return p.select(
        F.col("id").alias("player_id"),
        F.coalesce(F.col("element_type_id"), F.lit(0)).cast("bigint").alias("role"),
        F.col("team_id").cast("bigint").alias("team"),
        F.col("now_cost").cast("bigint").alias("cost"),
    )


def _requested(requests: DataFrame) -> Column:
    """The requested periods (a handful: one per gameweek at most) as an array, computed once."""
    return requests.agg(F.array_sort(F.collect_set("event_id"))).scalar()


def requested_scores(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """Scores of the requested periods in hundredths; the filter reaches below an aggregate that makes the scores."""
    sc = scores.where(F.array_contains(_requested(requests), F.col("event_id")))
    return sc.select(F.col("player_id").alias("_sp"), F.col("event_id").alias("_se"), to_cents(F.col("xpts")).alias("x"))


def squad_members(squads: DataFrame, players: DataFrame, sc: DataFrame, requests: DataFrame, preset: Preset) -> DataFrame:
    """Known squad members with role, team, cost and score (0 when missing); ``sc``: :func:`requested_scores`.

    Every join is keyed, and no side is broadcast by its estimate: squads ⋈
    requests on squad, ⋈ info on player, ⋈ scores on (player, period).
    """
    info, sc = player_info(players, preset), keyed(sc)
    m = keyed(squads.select("squad_id", "slot", "player_id")).join(requests.select("squad_id", "event_id"), "squad_id")
    m = m.join(keyed(info), "player_id", "inner")
    m = m.join(sc, (m["player_id"] == sc["_sp"]) & (m["event_id"] == sc["_se"]), "left")
    return m.withColumn("score", F.coalesce(F.col("x"), F.lit(0).cast("bigint"))).drop("_sp", "_se", "x")


def candidates(players: DataFrame, sc: DataFrame, requests: DataFrame, preset: Preset) -> DataFrame:
    """Buyers per requested period: (c_id, c_role, c_team, c_cost, c_event, x)."""
    info, sc = player_info(players, preset), keyed(sc)
    c = info.withColumn("c_event", F.explode(_requested(requests)))
    how = "inner" if preset.require_score else "left"
    c = c.join(sc, (c["player_id"] == sc["_sp"]) & (c["c_event"] == sc["_se"]), how).drop("_sp", "_se")
    return c.select(
        F.col("player_id").alias("c_id"),
        F.col("role").alias("c_role"),
        F.col("team").alias("c_team"),
        F.col("cost").alias("c_cost"),
        "c_event",
        F.coalesce(F.col("x"), F.lit(0).cast("bigint")).alias("x"),
    )


# ------------------------------------------------------------------ folds
# The greedy eleven is sequential (a pick depends on earlier picks' teams): an
# ``aggregate`` over the squad's array, evaluated in the JVM.


def _by_role(role: Column, values: list[Column]) -> Column:
    out = F.when(role == ROLES[0], values[0])
    for r, v in zip(ROLES[1:], values[1:]):
        out = out.when(role == r, v)
    return out


def greedy(order: Column, quotas: list[Column], ps_cap: int | None, require_gk: bool, track: Column | None = None, with_ids: bool = False) -> Column:
    """One greedy eleven over ``order`` (structs in pick order).

    Returns a struct: ``ok`` (every quota met), ``total``, and where asked for
    ``ids`` in pick order, or score and slot of the last pick in role ``track``.
    """
    none = F.lit(None).cast("bigint")
    fields = {f"c{r}": F.lit(0) for r in ROLES} | {"total": F.lit(0).cast("bigint")}
    if ps_cap is not None:
        fields["teams"] = F.array().cast("array<bigint>")
    if with_ids:
        fields["ids"] = F.array().cast("array<bigint>")
    if track is not None:
        fields |= {"ks": none, "kslot": none}

    def pick(acc: Column, e: Column) -> Column:
        count, quota = _by_role(e["role"], [acc[f"c{r}"] for r in ROLES]), _by_role(e["role"], quotas)
        take = count < quota
        if ps_cap is not None:
            take = take & (F.size(F.filter(acc["teams"], lambda t: t.eqNullSafe(e["team"]))) < ps_cap)
        new = {f"c{r}": acc[f"c{r}"] + (e["role"] == r).cast("int") for r in ROLES} | {"total": acc["total"] + e["score"]}
        if ps_cap is not None:
            new["teams"] = F.array_append(acc["teams"], e["team"])
        if with_ids:
            new["ids"] = F.array_append(acc["ids"], e["player_id"])
        if track is not None:
            last = (e["role"] == track) & (count + 1 == quota)
            new["ks"] = F.when(last, e["score"]).otherwise(acc["ks"])
            new["kslot"] = F.when(last, e["slot"].cast("bigint")).otherwise(acc["kslot"])
        return F.when(take, F.struct(*[v.alias(k) for k, v in new.items()])).otherwise(acc)

    def finish(acc: Column) -> Column:
        met = F.lit(True)
        for r, q in zip(ROLES, quotas):
            if r != 1 or require_gk:
                met = met & (acc[f"c{r}"] == q)
        kept = [acc[k].alias(k) for k in ("total", "ids", "ks", "kslot") if k in fields]
        return F.struct(met.alias("ok"), *kept)

    return F.aggregate(order, F.struct(*[v.alias(k) for k, v in fields.items()]), pick, finish)


def _of_role(order: Column, r: int) -> Column:
    return F.filter(order, lambda m: m["role"] == r)


def prefix_sums(order: Column, r: int) -> Column:
    """Sums of the best 0, 1, ... scores of a role, as many as it has members."""
    return F.aggregate(_of_role(order, r), F.array(F.lit(0).cast("bigint")), lambda acc, m: F.array_append(acc, F.element_at(acc, -1) + m["score"]))


def free_eleven(sums: list[Column], quotas: list[Column], require_gk: bool) -> tuple[Column, Column]:
    """(every quota met, total) of an eleven in which no team cap binds: the best of each role, from the prefix sums."""
    met, total = F.lit(True), F.lit(0).cast("bigint")
    for r, p, q in zip(ROLES, sums, quotas):
        if r != 1 or require_gk:
            met = met & (F.size(p) > q)
        total = total + F.element_at(p, F.least(F.size(p), q + 1))
    return met, total


def _cap_binds(known: Column, cap: int | None) -> Column:
    """Some team has more members in the squad than the eleven may hold: only then is the eleven a sequential choice."""
    if cap is None:
        return F.lit(False)
    teams = F.transform(known, lambda m: m["team"])
    return F.exists(F.array_distinct(teams), lambda t: F.size(F.filter(teams, lambda x: x.eqNullSafe(t))) > cap)


def _spread(squads: DataFrame) -> DataFrame:
    """Squads in the session's number of shuffle partitions, whatever their bytes.

    By a hash of the squad: a repartition by the column itself is dropped where
    the rows are partitioned by it already, and their shuffle is merged by size.
    """
    return squads.repartition(int(squads.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("squad_id"))


def _squad_arrays(members: DataFrame) -> DataFrame:
    """One row per squad: ``known`` (all known members) and ``order`` (positions 1 to 4 in greedy order).

    Both arrays hold the members of one squad, at most a squad's size. The folds
    over them cost far more than their bytes show, so the squads keep the
    session's number of shuffle partitions instead of being merged by size.
    """
    e = F.struct("role", (-F.col("score")).alias("neg"), "slot", "score", "team", "player_id", "cost")
    g = members.groupBy("squad_id", "event_id").agg(F.array_sort(F.collect_list(e)).alias("known"))
    return _spread(g).withColumn("order", F.filter("known", lambda m: m["role"].isin(*ROLES)))


def _numbered(i: int):
    return lambda g: F.struct(g["ok"].alias("ok"), g["total"].alias("total"), F.lit(-i).alias("first"), g["ids"].alias("ids"))


def _best_of(tried: Column, ps: Preset, fallback: Column) -> Column:
    """Struct of ``total`` and ``ids`` from tried elevens (``ok``, ``total``, ``first``, ``ids``); ties go to the first formation."""
    valid = F.filter(tried, lambda t: t["ok"] & (t["total"] > _NONE))
    best = F.array_max(F.transform(valid, lambda t: F.struct(t["total"], t["first"], t["ids"])))
    total = F.greatest(best["total"], F.lit(0).cast("bigint")) if ps.floor_zero else best["total"]
    return F.when(best.isNull(), fallback).otherwise(F.struct(total.alias("total"), best["ids"].alias("ids")))


def _with_eleven(arrays: DataFrame, ps: Preset) -> DataFrame:
    """Adds ``best``: total and ids of the best eleven of each squad."""
    order = F.col("order")
    arrays = arrays.withColumn("_binds", _cap_binds(F.col("known"), ps.cap)).withColumns({f"_p{r}": prefix_sums(order, r) for r in ROLES})
    sums = [F.col(f"_p{r}") for r in ROLES]

    def ids(f) -> Column:
        return F.concat(*[F.slice(F.transform(_of_role(order, r), lambda m: m["player_id"]), 1, q) for r, q in zip(ROLES, f)])

    free, walked = [], []
    for i, f in enumerate(ps.formations):
        ok, total = free_eleven(sums, [F.lit(q) for q in f], ps.require_gk)
        free.append(F.struct(ok.alias("ok"), total.alias("total"), F.lit(-i).alias("first"), ids(f).alias("ids")))
        if ps.cap is not None:
            walked.append(F.transform(F.array(greedy(order, [F.lit(q) for q in f], ps.cap, ps.require_gk, with_ids=True)), _numbered(i)))
    if ps.floor_zero:
        fallback = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("ids"))
    else:
        fallback = F.struct(free_eleven(sums, [F.lit(q) for q in ps.fallback], False)[1].alias("total"), ids(ps.fallback).alias("ids"))
    tried = F.array(*free)
    if walked:
        tried = F.when(F.col("_binds"), F.concat(*walked)).otherwise(tried)
    return arrays.withColumn("_tried", tried).withColumn("best", _best_of(F.col("_tried"), ps, fallback)).drop("_tried", *[f"_p{r}" for r in ROLES])


def best_eleven(
    squads: DataFrame, players: DataFrame, scores: DataFrame, requests: DataFrame, preset: str = "cli"
) -> DataFrame:
    """Best eleven per squad: ``squad_id, event_id, team_xpts, xi`` (ids in pick order)."""
    ps = PRESETS[preset]
    members = squad_members(squads, players, requested_scores(scores, requests), requests, ps)
    out = _with_eleven(_squad_arrays(members), ps).select("squad_id", "best")
    # Squads without any known member still get a row (total 0, empty eleven).
    req = requests.select("squad_id", "event_id")
    return req.join(out, "squad_id", "left").select(
        "squad_id",
        "event_id",
        (F.coalesce(F.col("best.total"), F.lit(0).cast("bigint")).cast("double") / F.lit(100.0)).alias("team_xpts"),
        F.coalesce(F.col("best.ids"), F.expr("CAST(array() AS ARRAY<BIGINT>)")).alias("xi"),
    )


# ------------------------------------------------------------------ swaps
def _seller_rows(members: DataFrame, requests: DataFrame, ps: Preset, cli: bool) -> DataFrame:
    """One row per (squad, seller) with the squad facts the buyer predicates need (owned ids, full teams,
    bank, period), the squad's current total and, per formation, A/B totals and B's kth pick."""
    arrays = _with_eleven(_squad_arrays(members), ps).withColumn("cur", F.col("best.total")).drop("best")
    teams = F.array_compact(F.transform("known", lambda m: m["team"]))
    s = (
        arrays.join(requests.select("squad_id", "bank_tenths"), "squad_id")
        .transform(_spread)
        .withColumn("owned", F.array_sort(F.array_distinct(F.transform("known", lambda m: m["player_id"]))))
        .withColumn("_teams", teams)
        .withColumn("o", F.explode("known"))
    )
    if cli:
        s = s.where(F.col("o.role").isin(*ROLES))
    held = lambda t: F.size(F.filter("_teams", lambda x: x == t))
    own = lambda t: F.col("o.team").eqNullSafe(t)
    if ps.same_team_ok:
        blocked = F.filter(F.array_distinct("_teams"), lambda t: (held(t) >= MAX_PER_TEAM) & ~own(t))
    else:
        blocked = F.filter(F.array_distinct("_teams"), lambda t: held(t) - own(t).cast("int") >= MAX_PER_TEAM)
    s = s.withColumn("blocked", blocked).withColumn("_others", F.filter("order", lambda m: m["slot"] != F.col("o.slot")))
    s = s.withColumns({f"_p{r}": prefix_sums(F.col("_others"), r) for r in ROLES})
    s = s.withColumn("_mine", F.filter("_others", lambda m: m["role"] == F.col("o.role")))
    sums = [F.col(f"_p{r}") for r in ROLES]
    plays = F.col("o.role").isin(*ROLES)
    formations = list(ps.formations) + ([ps.fallback] if ps.fallback else [])
    passes = {}
    for i, f in enumerate(formations):
        is_fallback = ps.fallback is not None and i == len(formations) - 1
        full = [F.lit(q) for q in f]
        fewer = [F.lit(q) - (F.col("o.role") == r).cast("int") for r, q in zip(ROLES, f)]
        ok_a, tot_a = free_eleven(sums, fewer, ps.require_gk)
        ok_b, tot_b = free_eleven(sums, full, ps.require_gk)
        kth = F.get("_mine", _by_role(F.col("o.role"), full) - 1)  # B's last pick in the seller's position, if there are so many
        free = F.struct(
            F.when(ok_a | F.lit(is_fallback), tot_a).alias("a"), F.when(ok_b | F.lit(is_fallback), tot_b).alias("b"),
            kth["score"].alias("ks"), kth["slot"].cast("bigint").alias("kslot"),
        )
        if ps.cap is None or is_fallback:
            passes[f"_f{i}"] = F.when(plays, free)
        else:
            walk = F.transform(
                F.array(F.struct(greedy(F.col("_others"), fewer, ps.cap, ps.require_gk).alias("a"),
                                 greedy(F.col("_others"), full, ps.cap, ps.require_gk, track=F.col("o.role")).alias("b"))),
                lambda w: F.struct(F.when(w["a"]["ok"], w["a"]["total"]).alias("a"), F.when(w["b"]["ok"], w["b"]["total"]).alias("b"),
                                   w["b"]["ks"].alias("ks"), w["b"]["kslot"].alias("kslot")),
            )[0]
            passes[f"_f{i}"] = F.when(plays & F.col("_binds"), walk).when(plays, free)
    s = s.withColumns(passes)
    out = []
    for i in range(len(formations)):
        f = F.col(f"_f{i}")
        # the buyer (taking this seller's slot) sorts before B's kth pick iff x >= t
        t = F.coalesce(f["ks"] + F.when(F.col("o.slot") < f["kslot"], 0).otherwise(1), F.lit(_NO_KTH))
        out += [f["a"].alias(f"a{i}"), f["b"].alias(f"b{i}"), F.when(plays, t).alias(f"t{i}")]
    return s.select(
        "squad_id", "event_id", "bank_tenths", F.col("o.slot").alias("o_slot"), F.col("o.player_id").alias("o_id"),
        F.col("o.role").alias("o_role"), F.col("o.cost").alias("o_cost"),
        (F.col("o.cost") + F.col("bank_tenths")).alias("price_limit"), "owned", "blocked", "cur", *out,
    )


def _new_total(ps: Preset, n_forms: int) -> Column:
    """Total of the best eleven after the swap, from the A/B passes and buyer score ``x``.

    Per formation: ``x >= t ? A + x : B``. The best valid total is the max of
    all totals when that max exceeds -1.00 (a smaller max means none is
    valid), so one ``greatest`` and one comparison suffice.
    """

    def total_of(i: int) -> Column:
        return F.when(F.col("x") >= F.col(f"t{i}"), F.col(f"a{i}") + F.col("x")).otherwise(F.col(f"b{i}"))

    totals = [total_of(i) for i in range(n_forms)]
    best = F.greatest(*totals) if len(totals) > 1 else totals[0]
    if ps.floor_zero:
        return F.greatest(F.lit(0).cast("bigint"), F.coalesce(best, F.lit(0).cast("bigint")))
    return F.when(best > _NONE, best).otherwise(total_of(n_forms))  # fallback is the last pass


def _rises(ps: Preset, n_forms: int) -> Column:
    """The seller's total never falls as the buyer's score rises."""
    ok, level = F.lit(True), F.lit(False)
    for i in range(n_forms):
        a, b, t = (F.col(f"{k}{i}") for k in "abt")
        flat = (t != _NO_KTH) & b.isNotNull()  # B applies to low scores
        ok = ok & (~flat | F.coalesce(a + t >= b, F.lit(False)))
        level = level | (flat & (b > _NONE))
    if not ps.floor_zero:
        ok = ok & level  # else low scores fall back to another eleven
    return ~F.col("o_role").isin(*ROLES) | F.coalesce(ok, F.lit(False))


#: What a buyer of the short lists takes in a broadcast hash table: five numbers in each of two arrays.
LIST_ROW_BYTES = 128


def short_lists(cands: DataFrame, sellers: DataFrame, top_n: int, squad_size: int) -> DataFrame:
    """Buyers that can rank for some seller, per (period, position, price limit): see the module's plan, step 3.

    First a cut per exact price, which bounds the table by the number of
    prices; then the buyers up to each limit that some seller has.
    """
    k = top_n + squad_size
    orders = ([F.col("x").desc(), F.col("c_id").asc()], [F.col("c_id").asc()])
    limits = sellers.select(F.col("event_id").alias("_le"), F.col("o_role").alias("_lr"), "price_limit").distinct()
    out = None
    for order in orders:
        first = cands.withColumn("_r", F.row_number().over(Window.partitionBy("c_event", "c_role", "c_team", "c_cost").orderBy(*order))).where(F.col("_r") <= k)
        upto = first.join(limits, (F.col("c_event") == F.col("_le")) & (F.col("c_role") == F.col("_lr")) & (F.col("c_cost") <= F.col("price_limit")))
        team = Window.partitionBy("c_event", "c_role", "price_limit", "c_team").orderBy(*order)
        every = Window.partitionBy("c_event", "c_role", "price_limit").orderBy(*order)
        kept = upto.withColumn("_r", F.row_number().over(team)).where(F.col("_r") <= k)
        kept = kept.withColumn("_r", F.row_number().over(every)).where(F.col("_r") <= (squad_size // MAX_PER_TEAM + 1) * k)
        kept = kept.select("c_event", "c_role", "price_limit", "c_id", "c_team", "c_cost", "x")
        out = kept if out is None else out.unionByName(kept)
    return out.distinct()


def _listed(lists: DataFrame) -> DataFrame:
    """One row per (period, position, price limit): its buyers by id and by score (then id), a bounded number."""
    keys = ["c_event", "c_role", "price_limit"]
    by_id = F.struct("c_id", (-F.col("x")).alias("neg"), "x", "c_team", "c_cost")
    by_score = F.struct((-F.col("x")).alias("neg"), "c_id", "x", "c_team", "c_cost")
    return lists.groupBy(*keys).agg(F.array_sort(F.collect_list(by_id)).alias("_by_id"), F.array_sort(F.collect_list(by_score)).alias("_by_score"))


def _first_feasible(near: DataFrame, top_n: int) -> DataFrame:
    """Of each seller's two arrays the first ``top_n`` feasible buyers, a row each: every swap that can rank is among them."""

    def first(order: str) -> Column:
        fits = lambda c: ~F.array_contains("owned", c["c_id"]) & ~F.coalesce(F.array_contains("blocked", c["c_team"]), F.lit(False))
        return F.transform(F.slice(F.filter(order, fits), 1, top_n), lambda c: F.struct(*[c[k].alias(k) for k in ("c_id", "c_team", "c_cost", "x")]))

    both = near.withColumn("_c", F.array_union(first("_by_id"), first("_by_score"))).drop("_by_id", "_by_score")
    # outer: a plain explode is preceded by a filter on the array's size, which makes the array once more
    return both.withColumn("_c", F.explode_outer("_c")).where("_c IS NOT NULL").select(*[c for c in both.columns if c != "_c"], "_c.*")


def _salted(sellers: DataFrame, buyers: DataFrame, on: list[tuple[str, str]], salts: int) -> DataFrame:
    """Equi-join whose keys have few values: the buyer side goes to every salt."""
    left = sellers.withColumn("_salt", F.pmod(F.xxhash64("squad_id", "o_slot"), F.lit(salts)))
    right = buyers.withColumn("_bsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = F.col("_salt") == F.col("_bsalt")
    for a, b in on:
        cond = cond & (left[a] == right[b])
    return left.join(right, cond).drop("_salt", "_bsalt")


def swap_suggestions(
    squads: DataFrame,
    players: DataFrame,
    scores: DataFrame,
    requests: DataFrame,
    preset: str = "cli",
    top_n: int = 10,
    salts: int = 64,
) -> DataFrame:
    """Top ``top_n`` one-for-one swaps per squad, best delta first.

    ``requests``: (squad_id, event_id, bank_tenths). Ties rank by squad slot of
    the seller, then buyer id. Columns: squad_id, event_id, rank, out_player_id,
    in_player_id, out_cost, in_cost, team_xpts_delta, new_team_xpts,
    current_team_xpts (hundredths converted back to two-decimal doubles).

    The requests, the scores of their periods, the buyers, the seller rows (≤ 15
    per squad) and the short lists are checkpointed in the shared folder: each is
    read more than once.
    """
    ps = PRESETS[preset]
    requests = cut_lineage(requests)
    sc = cut_lineage(requested_scores(scores, requests))
    members = squad_members(squads, players, sc, requests, ps)
    n_forms = len(ps.formations)
    sellers = cut_lineage(_seller_rows(members, requests, ps, cli=(preset == "cli")).withColumn("_rises", _rises(ps, n_forms)))
    size, others = sellers.agg(F.coalesce(F.max(F.size("owned")), F.lit(0)), F.count_if(~F.col("_rises"))).first()
    cands = cut_lineage(candidates(players, sc, requests, ps))
    rising, other = sellers.where(F.col("_rises")), sellers.where(~F.col("_rises"))
    lists = cut_lineage(_listed(short_lists(cands, rising, top_n, size))).withColumnRenamed("price_limit", "_limit")
    on = [("event_id", "c_event"), ("o_role", "c_role"), ("price_limit", "_limit")]
    listed = lists.agg(F.coalesce(F.sum(F.size("_by_id")), F.lit(0))).first()[0]
    if listed * LIST_ROW_BYTES <= BROADCAST_MAX_BYTES:
        cond = (rising["event_id"] == lists["c_event"]) & (rising["o_role"] == lists["c_role"]) & (rising["price_limit"] == lists["_limit"])
        near = rising.join(F.broadcast(lists), cond)
    else:
        near = _salted(rising, lists, on, salts)
    pairs = _first_feasible(near.drop("_limit"), top_n)
    if others:  # else every buyer would be sent to every salt for no seller
        pairs = pairs.unionByName(_salted(other, cands, on[:2], salts))
    feasible = pairs.where(
        (F.col("c_cost") <= F.col("price_limit"))
        & ~F.array_contains("owned", F.col("c_id"))
        & ~F.coalesce(F.array_contains("blocked", F.col("c_team")), F.lit(False))
    )
    new_total = F.when(F.col("o_role").isin(*ROLES), _new_total(ps, n_forms)).otherwise(F.col("cur"))
    scored = feasible.select(
        "squad_id", "event_id", "o_slot", "o_id", "c_id", "o_cost", "c_cost", "cur", new_total.alias("new")
    ).withColumn("delta", F.col("new") - F.col("cur"))
    w = Window.partitionBy("squad_id").orderBy(F.col("delta").desc(), F.col("o_slot").asc(), F.col("c_id").asc())
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return top.select(
        "squad_id",
        "event_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("o_id").alias("out_player_id"),
        F.col("c_id").alias("in_player_id"),
        F.col("o_cost").alias("out_cost"),
        F.col("c_cost").alias("in_cost"),
        (F.col("delta").cast("double") / F.lit(100.0)).alias("team_xpts_delta"),
        (F.col("new").cast("double") / F.lit(100.0)).alias("new_team_xpts"),
        (F.col("cur").cast("double") / F.lit(100.0)).alias("current_team_xpts"),
    )


def with_names(suggestions: DataFrame, players: DataFrame, missing: str = "") -> DataFrame:
    """Decorate suggestions with both players' names (missing → ``missing`` or the id text)."""
    names = keyed(players.select(F.col("id").alias("_nid"), F.col("web_name").alias("_name")))
    o = names.alias("o")
    i = names.alias("i")

    def fill(name_col, id_col):
        return F.coalesce(name_col, F.lit(missing) if missing is not None else id_col.cast("string"))

    return (
        suggestions.join(o, suggestions["out_player_id"] == F.col("o._nid"), "left")
        .join(i, suggestions["in_player_id"] == F.col("i._nid"), "left")
        .withColumn("out_web_name", fill(F.col("o._name"), F.col("out_player_id")))
        .withColumn("in_web_name", fill(F.col("i._name"), F.col("in_player_id")))
        .drop("_nid", "_name")
    )


def service_suggestions(squads, players, scores, requests, top_n: int = 10) -> DataFrame:
    """Service shape: names ('' when missing) and cost change in millions."""
    s = swap_suggestions(squads, players, scores, requests, "service", max(1, min(50, top_n)))
    s = with_names(s, players, missing="")
    return s.select(
        "squad_id",
        "event_id",
        "rank",
        "out_player_id",
        "in_player_id",
        "out_web_name",
        "in_web_name",
        "team_xpts_delta",
        "new_team_xpts",
        round2((F.col("in_cost") - F.col("out_cost")).cast("double") / F.lit(10.0)).alias("cost_delta_million"),
        "current_team_xpts",
    )


def cli_suggestions(squads, players, scores, requests, top_n: int = 10) -> DataFrame:
    """CLI shape: sell/buy ids and names ('' when the name is missing)."""
    s = swap_suggestions(squads, players, scores, requests, "cli", top_n)
    s = with_names(s, players, missing="")
    return s.select(
        "squad_id",
        "event_id",
        "rank",
        F.col("out_player_id").alias("sell_id"),
        F.col("in_player_id").alias("buy_id"),
        F.col("out_web_name").alias("sell_name"),
        F.col("in_web_name").alias("buy_name"),
        F.col("team_xpts_delta").alias("expected_points_difference"),
        "new_team_xpts",
        "current_team_xpts",
    )


# ------------------------------------------------------------------ squad facts
def squad_team_counts(squads: DataFrame, players: DataFrame) -> DataFrame:
    """Members per (squad, team)."""
    info = players.select(F.col("id").alias("player_id"), F.col("team_id"))
    return squads.join(info, "player_id").groupBy("squad_id", "team_id").agg(F.count(F.lit(1)).alias("n_players"))


def squad_positions(squads: DataFrame, players: DataFrame) -> DataFrame:
    """Members per position (goalkeepers, defenders, midfielders, forwards) per squad."""
    info = players.select(F.col("id").alias("player_id"), F.col("element_type_id").alias("r"))
    j = squads.join(info, "player_id")
    return j.groupBy("squad_id").agg(
        *[F.count_if(F.col("r") == r).alias(n) for r, n in zip(ROLES, ("n_gkp", "n_def", "n_mid", "n_fwd"))]
    )


def squad_value(squads: DataFrame, players: DataFrame, bank: DataFrame) -> DataFrame:
    """Budget in tenths = bank + current cost of every known member."""
    info = players.select(F.col("id").alias("player_id"), F.col("now_cost").cast("bigint").alias("cost"))
    costs = squads.join(info, "player_id").groupBy("squad_id").agg(F.sum("cost").alias("_c"))
    return bank.join(costs, "squad_id", "left").select(
        "squad_id", (F.col("bank_tenths") + F.coalesce(F.col("_c"), F.lit(0).cast("bigint"))).cast("bigint").alias("budget_tenths")
    )


# ------------------------------------------------------------------ requests and documents
def suggestion_requests(members: DataFrame, api_bank: DataFrame, given_bank: DataFrame, scores: DataFrame) -> DataFrame:
    """Service request rules per squad: bank, status and pick count.

    ``members``: (squad_id, player_id) picks; ``api_bank``: (squad_id,
    bank_million) from the picks document; ``given_bank``: (squad_id,
    bank_million) sent by the caller. An explicit bank wins unless it is 0 or
    absent; a squad must have exactly 15 picks; some expected points must
    exist (any period).
    """
    n = members.groupBy("squad_id").agg(F.count(F.lit(1)).alias("n_picks"))
    has_scores = scores.select(F.lit(True)).limit(1).scalar()
    g = given_bank.select("squad_id", F.col("bank_million").alias("_given"))
    a = api_bank.select("squad_id", F.col("bank_million").alias("_api"))
    r = n.join(keyed(a), "squad_id", "left").join(keyed(g), "squad_id", "left").withColumn("_has", has_scores)
    bank = F.when(F.coalesce(F.col("_given"), F.lit(0.0)) != 0.0, F.col("_given")).otherwise(F.coalesce(F.col("_api"), F.lit(0.0)))
    status = (
        F.when(F.col("n_picks") != 15, F.lit("bad_squad_size"))
        .when(F.col("_has").isNull(), F.lit("no_scores"))
        .otherwise(F.lit("ok"))
    )
    return r.select(
        "squad_id",
        F.col("n_picks").cast("int").alias("n_picks"),
        bank.alias("bank_million"),
        F.bround((bank * F.lit(10.0)).cast("decimal(20,6)"), 0).cast("bigint").alias("bank_tenths"),
        status.alias("status"),
    )


def suggestion_documents(suggestions: DataFrame, current: DataFrame) -> DataFrame:
    """One JSON document per squad: ``{event_id, current_team_xpts, suggestions: [...]}`` ranked.

    ``current``: one row per squad (``squad_id, event_id, team_xpts``, as
    :func:`best_eleven` gives); a squad without a feasible swap has an empty
    list. The list of a squad is bounded by ``top_n`` (≤ 50).
    """
    item = F.struct(
        "rank", "out_player_id", "in_player_id", "out_web_name", "in_web_name",
        "team_xpts_delta", "new_team_xpts", "cost_delta_million",
    )
    g = suggestions.groupBy("squad_id").agg(F.array_sort(F.collect_list(item)).alias("_s"))
    none = F.array().cast(g.schema["_s"].dataType)
    s = F.transform(F.coalesce("_s", none), lambda x: x.dropFields("rank"))
    doc = F.struct("event_id", F.col("team_xpts").alias("current_team_xpts"), s.alias("suggestions"))
    return current.join(g, "squad_id", "left").select("squad_id", "event_id", F.to_json(doc).alias("document"))


def write_documents(documents: DataFrame, root: str) -> None:
    """JSON Lines ``{squad_id, document}`` under ``{root}/event_id={period}``.

    Only the periods that ``documents`` has are replaced, so a run that is
    repeated leaves what it left before and the other periods stay.
    """
    line = F.to_json(F.struct("squad_id", "document"))
    documents.select(F.col("event_id").cast("bigint").alias("event_id"), line.alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("event_id").text(root)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``squad_id, event_id, document`` of everything that is published."""
    lines = spark.read.schema("value string, event_id bigint").format("text").load(root)
    d = F.from_json("value", "squad_id bigint, document string")
    return lines.select(d.alias("d"), "event_id").select("d.squad_id", "event_id", "d.document")
