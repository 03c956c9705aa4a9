"""DuckDB oracles for the squad optimiser.

Swaps are checked by brute force: every feasible (squad, seller, buyer) builds
its new squad and re-solves the eleven, with prefix sums per formation in the
uncapped rule set and position by position in the capped one. The capped
eleven of a squad as it is comes from a recursive greedy walk per formation.
"""

from __future__ import annotations

from leagueflow.operators.squads import CLI_FORMATIONS, PRESETS, SERVICE_FALLBACK
from leagueflow.plans.roles import role_cte

ROLES = (1, 2, 3, 4)
K = 5  # deepest prefix any formation needs


#: Money of a squad by the request rules of the proof: the picks document's bank, or what the caller gave, to whole tenths.
GIVEN_BANK = "CASE s.squad_id % 3 WHEN 0 THEN coalesce(b.bank_tenths, 0) WHEN 1 THEN 12 ELSE 14 END"


#: Periods that the callers of the proof name, by how far they are from the next one: squads of the first kind name none.
ASKED_PERIODS = {0: "squad_id % 4 < 2", 1: "squad_id % 4 = 2", 2: "squad_id % 4 = 3"}


def _base(preset: str, bank: str = "coalesce(b.bank_tenths, 0)") -> str:
    info_where = "now_cost IS NOT NULL" + (
        " AND element_type_id IS NOT NULL AND team_id IS NOT NULL" if preset == "cli" else ""
    )
    return role_cte("squads", "squad_players", "squad_scores", "squad_bank") + f""",
nxt AS (SELECT min(event_id) AS event_id FROM squad_scores),
req AS (SELECT DISTINCT s.squad_id, nxt.event_id, CAST({bank} AS BIGINT) AS bank_tenths
        FROM squads s CROSS JOIN nxt LEFT JOIN squad_bank b ON s.squad_id = b.squad_id),
sc AS (SELECT player_id, CAST(round(xpts * 100) AS BIGINT) AS x FROM squad_scores WHERE event_id = (SELECT event_id FROM nxt)),
info AS (SELECT id, web_name, CAST(coalesce(element_type_id, 0) AS BIGINT) AS role, team_id AS team, CAST(now_cost AS BIGINT) AS cost
         FROM squad_players WHERE {info_where}),
members AS (SELECT s.squad_id, s.slot, s.player_id, i.role, i.team, i.cost, coalesce(sc.x, 0) AS score
            FROM squads s JOIN info i ON i.id = s.player_id LEFT JOIN sc ON sc.player_id = s.player_id)"""


def _pivot(src: str, keys: str) -> str:
    """Per group: n_r and top-k prefix sums p_r_k (k ≤ 5) of scores in (score desc, slot) order."""
    cols = []
    for r in ROLES:
        cols.append(f"CAST(sum(CASE WHEN role = {r} THEN 1 ELSE 0 END) AS BIGINT) AS n_{r}")
        for k in range(1, K + 1):
            cols.append(f"sum(CASE WHEN role = {r} AND rk <= {k} THEN score ELSE 0 END) AS p_{r}_{k}")
    return (f"SELECT {keys}, {', '.join(cols)} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, role "
            f"ORDER BY score DESC, slot) AS rk FROM {src} WHERE role IN (1, 2, 3, 4)) AS r GROUP BY {keys}")


def _uncapped_total() -> str:
    """SQL expression over a pivot row: the service rule set's eleven total."""
    def p(r, k):
        return "0" if k == 0 else f"p_{r}_{k}"

    gk = "CASE WHEN n_1 >= 1 THEN p_1_1 ELSE 0 END"
    totals = []
    for _, d, m, f in PRESETS["service"].formations:
        totals.append(f"CASE WHEN n_2 >= {d} AND n_3 >= {m} AND n_4 >= {f} AND {gk} + {p(2, d)} + {p(3, m)} + {p(4, f)} > -100 "
                      f"THEN {gk} + {p(2, d)} + {p(3, m)} + {p(4, f)} END")
    _, d, m, f = SERVICE_FALLBACK
    fallback = f"{gk} + {p(2, d)} + {p(3, m)} + {p(4, f)}"  # p_r_k already sums only what exists
    return f"coalesce(greatest({', '.join(totals)}), {fallback})"


def best_xi_uncapped_sql() -> str:
    return _base("service") + f""",
piv AS ({_pivot('members', 'squad_id')})
SELECT req.squad_id, req.event_id, CAST(coalesce({_uncapped_total()}, 0) AS DOUBLE) / CAST(100.0 AS DOUBLE) AS team_xpts
FROM req LEFT JOIN piv ON piv.squad_id = req.squad_id"""


def swaps_service_sql(top_n: int = 10, bank: str = "coalesce(b.bank_tenths, 0)") -> str:
    return _base("service", bank) + f""",
cur AS (SELECT squad_id, {_uncapped_total()} AS cur FROM ({_pivot('members', 'squad_id')}) AS a),
counts AS (SELECT squad_id, team, count(*) AS n FROM members WHERE team IS NOT NULL GROUP BY squad_id, team),
cands AS (SELECT i.*, coalesce(sc.x, 0) AS x FROM info i LEFT JOIN sc ON sc.player_id = i.id),
pairs AS (
  SELECT m.squad_id, m.slot AS o_slot, m.player_id AS o_id, m.role AS o_role, m.cost AS o_cost, c.id AS c_id, c.cost AS c_cost, c.x
  FROM members m JOIN req ON req.squad_id = m.squad_id JOIN cands c ON c.role = m.role
  LEFT JOIN counts k ON k.squad_id = m.squad_id AND k.team = c.team
  WHERE c.cost <= m.cost + req.bank_tenths
    AND NOT EXISTS (SELECT 1 FROM members o WHERE o.squad_id = m.squad_id AND o.player_id = c.id)
    AND (c.team IS NULL OR c.team = m.team OR coalesce(k.n, 0) < 3)
),
newsq AS (
  SELECT p.squad_id, p.o_slot, p.c_id, m.slot, m.role, m.score FROM pairs p JOIN members m ON m.squad_id = p.squad_id AND m.slot <> p.o_slot
  UNION ALL SELECT squad_id, o_slot, c_id, o_slot AS slot, o_role AS role, x AS score FROM pairs
),
newt AS (SELECT squad_id, o_slot, c_id, {_uncapped_total()} AS new FROM ({_pivot('newsq', 'squad_id, o_slot, c_id')}) AS b),
scored AS (
  SELECT p.*, coalesce(n.new, cur.cur) AS new, cur.cur
  FROM pairs p JOIN cur ON cur.squad_id = p.squad_id LEFT JOIN newt n ON n.squad_id = p.squad_id AND n.o_slot = p.o_slot AND n.c_id = p.c_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY squad_id ORDER BY new - cur DESC, o_slot, c_id) AS rank FROM scored)
SELECT r.squad_id, (SELECT event_id FROM nxt) AS event_id, CAST(r.rank AS INT) AS rank, r.o_id AS out_player_id, r.c_id AS in_player_id,
       coalesce(io.web_name, '') AS out_web_name, coalesce(ii.web_name, '') AS in_web_name,
       CAST(r.new - r.cur AS DOUBLE) / CAST(100.0 AS DOUBLE) AS team_xpts_delta,
       CAST(r.new AS DOUBLE) / CAST(100.0 AS DOUBLE) AS new_team_xpts,
       floor(CAST(r.c_cost - r.o_cost AS DOUBLE) / CAST(10.0 AS DOUBLE) * CAST(100.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100.0 AS DOUBLE) AS cost_delta_million,
       CAST(r.cur AS DOUBLE) / CAST(100.0 AS DOUBLE) AS current_team_xpts
FROM ranked r LEFT JOIN squad_players io ON io.id = r.o_id LEFT JOIN squad_players ii ON ii.id = r.c_id
WHERE r.rank <= {top_n}"""


def _walk(src: str, keys: str, quota_sql: list[str], name: str = "walk") -> str:
    """Recursive greedy (cap 3 per team) over ``src`` rows (keys..., idx, player_id, role, team, score)
    in idx order; returns the state per key group and step."""
    k_list = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{k} = w.{k}" for k in k_list)
    wk = ", ".join(f"w.{k}" for k in k_list)
    q = quota_sql
    cnt = "CASE s.role WHEN 1 THEN w.c1 WHEN 2 THEN w.c2 WHEN 3 THEN w.c3 WHEN 4 THEN w.c4 END"
    quo = f"CASE s.role WHEN 1 THEN {q[0]} WHEN 2 THEN {q[1]} WHEN 3 THEN {q[2]} WHEN 4 THEN {q[3]} END"
    take = f"({cnt} < {quo} AND len(list_filter(w.teams, lambda t: t = s.team)) < 3)"
    return f"""
  SELECT {keys}, 0 AS idx, CAST([] AS BIGINT[]) AS teams, 0 AS c1, 0 AS c2, 0 AS c3, 0 AS c4, CAST(0 AS BIGINT) AS tot, CAST([] AS BIGINT[]) AS ids
  FROM (SELECT DISTINCT {keys} FROM {src}) AS g
  UNION ALL
  SELECT {wk}, s.idx,
         CASE WHEN {take} THEN list_append(w.teams, s.team) ELSE w.teams END,
         w.c1 + CASE WHEN {take} AND s.role = 1 THEN 1 ELSE 0 END,
         w.c2 + CASE WHEN {take} AND s.role = 2 THEN 1 ELSE 0 END,
         w.c3 + CASE WHEN {take} AND s.role = 3 THEN 1 ELSE 0 END,
         w.c4 + CASE WHEN {take} AND s.role = 4 THEN 1 ELSE 0 END,
         w.tot + CASE WHEN {take} THEN s.score ELSE 0 END,
         CASE WHEN {take} THEN list_append(w.ids, s.player_id) ELSE w.ids END
  FROM {name} w JOIN {src} s ON {on} AND s.idx = w.idx + 1"""


def best_xi_capped_sql() -> str:
    forms = " UNION ALL ".join(
        f"SELECT {i} AS f, {g} AS q1, {d} AS q2, {m} AS q3, {w} AS q4" for i, (g, d, m, w) in enumerate(CLI_FORMATIONS)
    )
    return _base("cli").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
forms AS ({forms}),
seq AS (SELECT fo.f, fo.q1, fo.q2, fo.q3, fo.q4, m.squad_id, m.player_id, m.role, m.team, m.score, m.slot,
               row_number() OVER (PARTITION BY fo.f, m.squad_id ORDER BY m.role, m.score DESC, m.slot) AS idx
        FROM members m CROSS JOIN forms fo WHERE m.role IN (1, 2, 3, 4)),
walk AS ({_walk('seq', 'f, squad_id', ['s.q1', 's.q2', 's.q3', 's.q4'])}),
fin AS (SELECT w.* FROM walk w JOIN (SELECT f, squad_id, max(idx) AS mx FROM walk GROUP BY f, squad_id) AS l
        ON l.f = w.f AND l.squad_id = w.squad_id AND l.mx = w.idx),
ok AS (SELECT fin.squad_id, max(fin.tot) AS best FROM fin JOIN forms fo ON fo.f = fin.f
       WHERE fin.c1 = fo.q1 AND fin.c2 = fo.q2 AND fin.c3 = fo.q3 AND fin.c4 = fo.q4 AND fin.tot > -100 GROUP BY fin.squad_id)
SELECT req.squad_id, req.event_id, CAST(greatest(0, coalesce(ok.best, 0)) AS DOUBLE) / CAST(100.0 AS DOUBLE) AS team_xpts
FROM req LEFT JOIN ok ON ok.squad_id = req.squad_id"""


def swaps_cli_sql(top_n: int = 10) -> str:
    """Capped swaps by brute force: every feasible (squad, seller, buyer) re-solves the eleven in all formations.

    Position by position: a player can be picked while its team has been
    picked fewer than three times, counting the positions before and the
    better players of its own team in this one; of those the quota's best are.
    """
    forms = ", ".join(f"({i}, {d}, {m}, {w})" for i, (_, d, m, w) in enumerate(CLI_FORMATIONS))
    eleven = best_xi_capped_sql().split("\nSELECT req.squad_id, req.event_id", 1)[0]
    p = "squad_id, o_slot, c_id"
    best_first = "ORDER BY score DESC, slot"
    return eleven + f""",
cur AS (SELECT req.squad_id, greatest(0, coalesce(ok.best, 0)) AS cur FROM req LEFT JOIN ok ON ok.squad_id = req.squad_id),
counts AS (SELECT squad_id, team, count(*) AS n FROM members GROUP BY squad_id, team),
pairs AS (
  SELECT m.squad_id, m.slot AS o_slot, m.player_id AS o_id, m.role AS o_role, c.id AS c_id, c.team AS c_team, sc.x
  FROM members m JOIN req ON req.squad_id = m.squad_id JOIN info c ON c.role = m.role JOIN sc ON sc.player_id = c.id
  LEFT JOIN counts k ON k.squad_id = m.squad_id AND k.team = c.team
  WHERE m.role IN (1, 2, 3, 4) AND c.cost <= m.cost + req.bank_tenths
    AND NOT EXISTS (SELECT 1 FROM members o WHERE o.squad_id = m.squad_id AND o.player_id = c.id)
    AND coalesce(k.n, 0) - CASE WHEN c.team = m.team THEN 1 ELSE 0 END < 3
),
fs(f, q2, q3, q4) AS (VALUES {forms}),
vs AS (SELECT DISTINCT q2 FROM fs),
newsq AS (
  SELECT {", ".join("p." + c for c in p.split(", "))}, m.slot, m.role, m.team, m.score FROM pairs p JOIN members m ON m.squad_id = p.squad_id AND m.slot <> p.o_slot
  UNION ALL SELECT {p}, o_slot AS slot, o_role AS role, c_team AS team, x AS score FROM pairs
),
ranked_in_team AS (SELECT *, row_number() OVER (PARTITION BY {p}, role, team {best_first}) AS tr FROM newsq WHERE role IN (1, 2, 3, 4)),
gk AS (SELECT *, row_number() OVER (PARTITION BY {p} {best_first}) AS er FROM ranked_in_team WHERE role = 1 AND tr <= 3),
u1 AS (SELECT {p}, team, 1 AS n FROM gk WHERE er = 1),
df AS (SELECT b.*, row_number() OVER (PARTITION BY {p} {best_first}) AS er FROM ranked_in_team b LEFT JOIN u1 USING ({p}, team)
       WHERE role = 2 AND tr + coalesce(n, 0) <= 3),
u2 AS (SELECT q2, {p}, team, count(*) AS n FROM (SELECT q2, {p}, team FROM df, vs WHERE er <= q2 UNION ALL SELECT q2, {p}, team FROM u1, vs) AS t GROUP BY ALL),
md AS (SELECT q2, {p}, team, score, row_number() OVER (PARTITION BY q2, {p} {best_first}) AS er
       FROM (SELECT * FROM ranked_in_team, vs WHERE role = 3) AS b LEFT JOIN u2 USING (q2, {p}, team) WHERE tr + coalesce(n, 0) <= 3),
u3 AS (SELECT f, {p}, team, count(*) AS n FROM (
         SELECT f, {p}, team FROM md JOIN fs USING (q2) WHERE er <= q3 UNION ALL SELECT f, {p}, team FROM df, fs WHERE er <= q2
         UNION ALL SELECT f, {p}, team FROM u1, fs) AS t GROUP BY ALL),
fw AS (SELECT f, {p}, score, row_number() OVER (PARTITION BY f, {p} {best_first}) AS er
       FROM (SELECT * FROM ranked_in_team, fs WHERE role = 4) AS b LEFT JOIN u3 USING (f, {p}, team) WHERE tr + coalesce(n, 0) <= 3),
eleven AS (SELECT f, {p}, sum(score) AS tot FROM (
             SELECT f, {p}, score FROM gk, fs WHERE er = 1 UNION ALL SELECT f, {p}, score FROM df, fs WHERE er <= q2
             UNION ALL SELECT f, {p}, score FROM md JOIN fs USING (q2) WHERE er <= q3 UNION ALL SELECT f, {p}, score FROM fw JOIN fs USING (f) WHERE er <= q4
           ) AS t GROUP BY f, {p} HAVING count(*) = 11),
solved AS (SELECT {p}, max(tot) AS best FROM eleven WHERE tot > -100 GROUP BY {p}),
scored AS (SELECT p.*, CAST(greatest(0, coalesce(s.best, 0)) AS BIGINT) AS new, cur.cur
           FROM pairs p JOIN cur ON cur.squad_id = p.squad_id LEFT JOIN solved s ON s.squad_id = p.squad_id AND s.o_slot = p.o_slot AND s.c_id = p.c_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY squad_id ORDER BY new - cur DESC, o_slot, c_id) AS rank FROM scored)
SELECT r.squad_id, (SELECT event_id FROM nxt) AS event_id, CAST(r.rank AS INT) AS rank, r.o_id AS sell_id, r.c_id AS buy_id,
       coalesce(io.web_name, '') AS sell_name, coalesce(ii.web_name, '') AS buy_name,
       CAST(r.new - r.cur AS DOUBLE) / CAST(100.0 AS DOUBLE) AS expected_points_difference,
       CAST(r.new AS DOUBLE) / CAST(100.0 AS DOUBLE) AS new_team_xpts,
       CAST(r.cur AS DOUBLE) / CAST(100.0 AS DOUBLE) AS current_team_xpts
FROM ranked r LEFT JOIN squad_players io ON io.id = r.o_id LEFT JOIN squad_players ii ON ii.id = r.c_id
WHERE r.rank <= {top_n}"""


def lineups_sql() -> str:
    """The elevens themselves, both rule sets, in pick order (position, then score, then slot)."""
    capped = best_xi_capped_sql().split("\nSELECT req.squad_id, req.event_id", 1)[0] + """,
won AS (SELECT fin.squad_id, arg_max(fin.ids, fin.tot * 100 - fin.f) AS ids FROM fin JOIN forms fo ON fo.f = fin.f
        WHERE fin.c1 = fo.q1 AND fin.c2 = fo.q2 AND fin.c3 = fo.q3 AND fin.c4 = fo.q4 AND fin.tot > -100 GROUP BY fin.squad_id)
SELECT squad_id, 'cli' AS rules, CAST(unnest(range(len(ids))) AS INT) AS pick, unnest(ids) AS player_id FROM won"""
    forms = " UNION ALL ".join(f"SELECT {i} AS f, {d} AS q2, {m} AS q3, {w} AS q4" for i, (_, d, m, w) in enumerate(PRESETS["service"].formations))
    _, d, m, w = SERVICE_FALLBACK
    free = _base("service") + f""",
forms AS ({forms}),
placed AS (SELECT *, row_number() OVER (PARTITION BY squad_id, role ORDER BY score DESC, slot) AS rk FROM members WHERE role IN (1, 2, 3, 4)),
tried AS (SELECT squad_id, f, q2, q3, q4,
                 sum(CASE WHEN rk <= quota THEN score ELSE 0 END) AS tot,
                 sum(CASE WHEN role > 1 AND rk <= quota THEN 1 ELSE 0 END) AS taken
          FROM (SELECT placed.*, forms.*, CASE role WHEN 1 THEN 1 WHEN 2 THEN q2 WHEN 3 THEN q3 ELSE q4 END AS quota FROM placed, forms) AS g
          GROUP BY squad_id, f, q2, q3, q4),
best AS (SELECT squad_id, arg_max({{'q2': q2, 'q3': q3, 'q4': q4}}, tot * 100 - f) AS q FROM tried WHERE taken = q2 + q3 + q4 AND tot > -100 GROUP BY squad_id),
picked AS (SELECT p.squad_id, p.player_id, p.role, p.rk FROM placed p LEFT JOIN best b ON b.squad_id = p.squad_id
           WHERE p.rk <= CASE p.role WHEN 1 THEN 1 WHEN 2 THEN coalesce(b.q.q2, {d}) WHEN 3 THEN coalesce(b.q.q3, {m}) ELSE coalesce(b.q.q4, {w}) END)
SELECT squad_id, 'service' AS rules, CAST(row_number() OVER (PARTITION BY squad_id ORDER BY role, rk) - 1 AS INT) AS pick, player_id FROM picked"""
    return f"SELECT * FROM ({capped}) AS a UNION ALL SELECT * FROM ({free}) AS b"


def _later(sql: str, periods: int) -> str:
    """The same question about a later period, for the squads that ask for it."""
    mine = f"squads AS (SELECT * FROM all_squads WHERE {ASKED_PERIODS[periods]}),\nnxt AS (SELECT min(event_id) + {periods} AS event_id FROM squad_scores),"
    return sql.replace("squads AS (", "all_squads AS (").replace("nxt AS (SELECT min(event_id) AS event_id FROM squad_scores),", mine)


def answers_sql(top_n: int) -> str:
    """Requests by their rules: squads of 15 get their documents, for the period they name, with the money that the rules give them."""
    docs = " UNION ALL ".join(f"SELECT * FROM ({_later(suggestion_docs_sql(top_n, GIVEN_BANK), k)}) AS d{k}" for k in ASKED_PERIODS)
    return f"""
SELECT q.squad_id, q.status, d.event_id, d.current_team_xpts, d.pos, d.out_player_id, d.in_player_id, d.team_xpts_delta, d.cost_delta_million
FROM ({suggestion_requests_sql()}) AS q LEFT JOIN ({docs}) AS d ON d.squad_id = q.squad_id AND q.status = 'ok'"""


def suggestion_docs_sql(top_n: int, bank: str = "coalesce(b.bank_tenths, 0)") -> str:
    """Every squad with its current total, and its swaps in rank order where it has any."""
    return f"""
SELECT b.squad_id, b.event_id, b.team_xpts AS current_team_xpts, CAST(r.rank - 1 AS INT) AS pos, r.out_player_id, r.in_player_id,
       r.out_web_name, r.in_web_name, r.team_xpts_delta, r.new_team_xpts, r.cost_delta_million
FROM ({best_xi_uncapped_sql()}) AS b LEFT JOIN ({swaps_service_sql(top_n, bank)}) AS r ON r.squad_id = b.squad_id"""


def suggestion_requests_sql() -> str:
    return role_cte("squads", "squad_bank", "squad_scores") + """
SELECT q.squad_id, CAST(q.n AS INT) AS n_picks,
       CASE q.squad_id % 3 WHEN 0 THEN coalesce(CAST(b.bank_tenths AS DOUBLE) / 10, 0.0) WHEN 1 THEN CAST(1.25 AS DOUBLE) ELSE CAST(1.35 AS DOUBLE) END AS bank_million,
       CASE q.squad_id % 3 WHEN 0 THEN coalesce(b.bank_tenths, 0) WHEN 1 THEN CAST(12 AS BIGINT) ELSE CAST(14 AS BIGINT) END AS bank_tenths,
       CASE WHEN q.n <> 15 THEN 'bad_squad_size' WHEN NOT EXISTS (SELECT 1 FROM squad_scores) THEN 'no_scores' ELSE 'ok' END AS status
FROM (SELECT squad_id, count(*) AS n FROM squads GROUP BY squad_id) AS q LEFT JOIN squad_bank b ON b.squad_id = q.squad_id"""
