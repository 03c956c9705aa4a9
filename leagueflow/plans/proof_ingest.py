"""Proof entries for ingestion, lineage, upsert, selection, quality and squad
facts. Bronze documents are built by Spark from the driver's tables
(``to_json`` over bounded groups) and parsed back by the library; the oracle
is the plain role rows.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from leagueflow.functions import keys
from leagueflow.functions.casts import safe_float, safe_int, safe_ts_utc
from leagueflow.operators import incremental, quality
from leagueflow.operators import squads as sq
from leagueflow.plans.proof import D, FORM_SQL, PERIODS_SQL, SIDES_SQL, UPCOMING_SQL, XPTS_SQL, _roles, _w, _xpts_frame, proof
from leagueflow.plans.roles import AS_OF, BASE_YEAR, read_table, role, role_cte
from leagueflow.sources import payloads, tables
from leagueflow.streaming import ingest

DOC_ROWS = 64  # rows per generated bronze document (bounded documents)
BASE = "https://fantasy.example/api/"


def _iso(c):
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def _num_text(c):
    return c.cast("string")


# ---------------------------------------------------------------- bootstrap documents
def player_docs(players):
    elem = F.struct(
        F.col("id"), F.col("web_name"), F.col("first_name"), F.col("second_name"), F.col("team_id").alias("team"),
        F.col("element_type_id").alias("element_type"), F.col("now_cost"), F.col("status"), F.col("minutes"),
        F.col("total_points"), _num_text(F.col("selected_by_percent")).alias("selected_by_percent"),
        _num_text(F.col("form")).alias("form"), _num_text(F.col("points_per_game")).alias("points_per_game"),
        _num_text(F.col("expected_goals")).alias("expected_goals"), F.col("expected_assists"),
        _num_text(F.col("expected_goal_involvements")).alias("expected_goal_involvements"),
        F.col("expected_goals_conceded"),
    )
    return players.groupBy(F.floor(F.col("id") / DOC_ROWS).alias("doc")).agg(
        F.to_json(F.struct(F.collect_list(elem).alias("elements"))).alias("payload")
    )


PLAYER_COLS = ("id, web_name, first_name, second_name, team_id, element_type_id, now_cost, status, minutes, total_points, "
               "selected_by_percent, form, points_per_game, expected_goals, expected_assists, "
               "expected_goal_involvements, expected_goals_conceded")


@proof("parse_players", role_cte("players") + f"SELECT {PLAYER_COLS} FROM players")
def q_parse_players(spark, sf):
    return payloads.parse_players(player_docs(role(spark, sf, "players")))


@proof("parse_teams", role_cte("teams") + "SELECT id, name, short_name, strength FROM teams")
def q_parse_teams(spark, sf):
    t = role(spark, sf, "teams")
    docs = t.groupBy(F.floor(F.col("id") / DOC_ROWS).alias("doc")).agg(
        F.to_json(F.struct(F.collect_list(F.struct("id", "name", "short_name", _num_text(F.col("strength")).alias("strength"))).alias("teams"))).alias("payload")
    )
    return payloads.parse_teams(docs)


@proof("parse_positions", role_cte("element_types") + "SELECT id, singular_name_short, singular_name, squad_select FROM element_types")
def q_parse_positions(spark, sf):
    t = role(spark, sf, "element_types")
    docs = t.groupBy(F.floor(F.col("id") / DOC_ROWS).alias("doc")).agg(
        F.to_json(F.struct(F.collect_list(F.struct("id", "singular_name_short", "singular_name", "squad_select")).alias("element_types"))).alias("payload")
    )
    return payloads.parse_positions(docs)


@proof("parse_events", role_cte("events") + "SELECT id, name, date_trunc('second', deadline_time) AS deadline_time, finished, is_current, is_next FROM events")
def q_parse_events(spark, sf):
    t = role(spark, sf, "events")
    e = F.struct("id", "name", _iso(F.col("deadline_time")).alias("deadline_time"), "finished", "is_current", "is_next")
    docs = t.groupBy(F.floor(F.col("id") / DOC_ROWS).alias("doc")).agg(
        F.to_json(F.struct(F.collect_list(e).alias("events"))).alias("payload")
    )
    return payloads.parse_events(docs)


@proof(
    "parse_fixtures",
    role_cte("fixtures")
    + "SELECT id, event_id, team_h, team_a, kickoff_time, finished, team_h_difficulty, team_a_difficulty FROM fixtures",
)
def q_parse_fixtures(spark, sf):
    f = role(spark, sf, "fixtures")
    e = F.struct(
        "id", F.col("event_id").alias("event"), "team_h", "team_a", _iso(F.col("kickoff_time")).alias("kickoff_time"),
        "finished", _num_text(F.col("team_h_difficulty")).alias("team_h_difficulty"), "team_a_difficulty",
    )
    docs = f.groupBy(F.floor(F.col("id") / DOC_ROWS).alias("doc")).agg(F.to_json(F.collect_list(e)).alias("payload"))
    return payloads.parse_fixtures(docs)


# ---------------------------------------------------------------- per-player documents
HIST_COLS = ("minutes", "total_points", "goals_scored", "assists", "clean_sheets", "goals_conceded",
             "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded")

# A game without a fixture id gets its key from its place in the document of its player and season.
HISTORY_BODY = f"""
SELECT player_id,
       coalesce(fixture_id, -(coalesce(event_id, 0) * 1000
                + (row_number() OVER (PARTITION BY player_id, floor((event_id - 1) / {ingest.SEASON_PERIODS})
                                      ORDER BY abs(fixture_id_effective)) - 1))) AS fixture_id_effective,
       fixture_id, event_id, {', '.join(HIST_COLS)}
FROM player_match_history"""
HISTORY_SQL = role_cte("player_match_history") + HISTORY_BODY
FUTURE_SQL = role_cte("player_future_fixtures") + (
    "SELECT player_id, fixture_id, event_id, is_home, opponent_team, kickoff_time, difficulty FROM player_future_fixtures"
)


def summary_docs(spark, sf):
    r = _roles(spark, sf, "player_match_history", "player_future_fixtures")
    return ingest.summary_docs(r["player_match_history"], r["player_future_fixtures"])


@proof("parse_history", HISTORY_SQL)
def q_parse_history(spark, sf):
    return payloads.parse_history(summary_docs(spark, sf))


@proof("parse_future", FUTURE_SQL)
def q_parse_future(spark, sf):
    return payloads.parse_future(summary_docs(spark, sf))


# ---------------------------------------------------------------- squads as documents
def pick_docs(spark, sf):
    r = _roles(spark, sf, "squads", "squad_bank")
    pick = F.struct(
        F.col("slot").alias("_ord"), F.col("player_id").alias("element"), F.col("slot").alias("position"),
        (F.col("slot") == 1).alias("is_captain"), (F.col("slot") == 2).alias("is_vice_captain"),
        F.when(F.col("slot") > 11, F.lit(0)).otherwise(F.lit(1)).alias("multiplier"),
    )
    docs = r["squads"].groupBy("squad_id").agg(F.array_sort(F.collect_list(pick)).alias("picks"))
    docs = docs.join(r["squad_bank"].hint("shuffle_hash"), "squad_id", "left")
    eh = F.struct(F.col("bank_tenths").alias("bank"), (F.col("bank_tenths") * 10).alias("value"),
                  F.lit(1).alias("event_transfers"), F.lit(0).alias("event_transfers_cost"))
    return docs.select("squad_id", F.to_json(F.struct("picks", eh.alias("entry_history"))).alias("payload"))


@proof(
    "parse_picks",
    role_cte("squads")
    + """
SELECT squad_id, CAST(slot - 1 AS INT) AS pick_index, player_id AS element, slot AS position,
       (slot = 1) AS is_captain, (slot = 2 OR slot > 11) AS is_vice_captain
FROM squads""",
)
def q_parse_picks(spark, sf):
    return payloads.parse_picks(pick_docs(spark, sf), ["squad_id"])


@proof(
    "squad_from_picks",
    role_cte("squads", "squad_bank")
    + """
SELECT s.squad_id, CAST(s.slot - 1 AS INT) AS pick_index, s.player_id,
       CAST(b.bank_tenths AS DOUBLE) / CAST(10.0 AS DOUBLE) AS bank_million
FROM squads s LEFT JOIN squad_bank b ON s.squad_id = b.squad_id""",
)
def q_squad_from_picks(spark, sf):
    members, bank = payloads.squad_from_picks(pick_docs(spark, sf), ["squad_id"])
    return members.join(bank, "squad_id", "left")


@proof(
    "parse_entry",
    role_cte("squads", "squad_bank")
    + """
SELECT DISTINCT s.squad_id, b.bank_tenths AS bank, b.bank_tenths * 10 AS value,
       CAST(1 AS BIGINT) AS event_transfers, CAST(0 AS BIGINT) AS event_transfers_cost
FROM squads s LEFT JOIN squad_bank b ON s.squad_id = b.squad_id""",
)
def q_parse_entry(spark, sf):
    return payloads.parse_entry(pick_docs(spark, sf), ["squad_id"])


def _entry_history_docs(spark, sf):
    """One document per customer: an entry per month of orders and one per year, so both lists are bounded by the calendar."""
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.floor("o_totalprice").alias("price"))
    month = ((F.year("o_orderdate") - BASE_YEAR) * 12 + F.month("o_orderdate")).alias("event")
    monthly = o.groupBy("o_custkey", month).agg(
        F.max(F.floor(F.col("price") / 10000)).alias("points"), F.sum("price").alias("total_points"), F.min("o_orderkey").alias("rank"),
        F.sum(F.col("o_orderkey") % 3).alias("event_transfers"), F.sum(F.col("o_orderkey") % 2 * 4).alias("event_transfers_cost"),
        F.max(F.floor(F.col("price") / 1000)).alias("value"), F.sum(F.col("o_orderkey") % 9).alias("points_on_bench"),
    )
    yearly = o.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("price").alias("total_points"), F.min("o_orderkey").alias("rank"))
    current = monthly.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(*[c for c in monthly.columns if c != "o_custkey"]))).alias("current"))
    season = F.struct("y", F.concat(F.lit("S"), F.col("y").cast("string")).alias("season_name"), "total_points", "rank")
    past = yearly.groupBy("o_custkey").agg(F.array_sort(F.collect_list(season)).alias("past"))
    return current.join(past, "o_custkey").select(
        F.col("o_custkey").alias("entry_id"), F.to_json(F.struct("current", "past")).alias("payload")
    )


MONTHLY_SQL = f"""
monthly AS (
  SELECT o_custkey AS entry_id, CAST((year(o_orderdate) - {BASE_YEAR}) * 12 + month(o_orderdate) AS BIGINT) AS event,
         CAST(max(floor(floor(o_totalprice) / 10000)) AS BIGINT) AS points, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_points,
         min(o_orderkey) AS rank, CAST(sum(o_orderkey % 3) AS BIGINT) AS event_transfers,
         CAST(sum(o_orderkey % 2 * 4) AS BIGINT) AS event_transfers_cost, CAST(max(floor(floor(o_totalprice) / 1000)) AS BIGINT) AS value,
         CAST(sum(o_orderkey % 9) AS BIGINT) AS points_on_bench
  FROM orders GROUP BY 1, 2)"""


@proof(
    "parse_entry_history",
    f"WITH {MONTHLY_SQL.strip()}\nSELECT *, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY event) - 1 AS INT) AS idx FROM monthly",
)
def q_parse_entry_history(spark, sf):
    cur, _ = payloads.parse_entry_history(_entry_history_docs(spark, sf), ["entry_id"])
    return cur


@proof(
    "parse_entry_past",
    """
SELECT o_custkey AS entry_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY y) - 1 AS INT) AS idx,
       concat('S', CAST(y AS STRING)) AS season_name, CAST(tp AS BIGINT) AS total_points, rk AS rank
FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(floor(o_totalprice)) AS tp, min(o_orderkey) AS rk
      FROM orders GROUP BY o_custkey, year(o_orderdate)) AS t""",
)
def q_parse_entry_past(spark, sf):
    _, past = payloads.parse_entry_history(_entry_history_docs(spark, sf), ["entry_id"])
    return past


@proof(
    "entry_latest",
    f"""
WITH {MONTHLY_SQL.strip()}
SELECT entry_id, CAST(count(*) AS INT) AS n_current, max(event) AS latest_event, arg_max(points, event) AS latest_points,
       arg_max(total_points, event) AS latest_total_points, arg_max(value, event) AS latest_value,
       arg_max(event_transfers, event) AS latest_event_transfers, CAST(count(DISTINCT floor((event - 1) / 12)) AS INT) AS n_past
FROM monthly GROUP BY entry_id""",
)
def q_entry_latest(spark, sf):
    return payloads.entry_summary(_entry_history_docs(spark, sf), ["entry_id"])


@proof("squad_csv", role_cte("squads") + "SELECT squad_id, CAST(slot - 1 AS INT) AS pos, player_id FROM squads")
def q_squad_csv(spark, sf):
    s = role(spark, sf, "squads")
    txt = s.groupBy("squad_id").agg(
        F.concat(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("slot", "player_id"))),
                            lambda x: F.concat(F.lit(" "), x["player_id"].cast("string"))), ","),
            F.lit(", ,"),
        ).alias("csv")
    )
    return payloads.parse_id_list(txt, "csv", ["squad_id"])


# ---------------------------------------------------------------- lineage keys
def _urls(spark, sf):
    ev = read_table(spark, sf, "events")
    built = ev.select(
        F.col("event_id").alias("src_id"),
        F.when(F.col("event_type") == "view", F.concat(F.lit(BASE), F.lit("element-summary/"), F.col("user_id").cast("string"), F.lit("/")))
        .when(F.col("event_type") == "click", F.concat(F.lit(BASE), F.lit("entry/"), F.col("user_id").cast("string"), F.lit("/event/"),
                                                       (F.col("event_id") % 38 + 1).cast("string"), F.lit("/picks/")))
        .when(F.col("event_type") == "signup", F.concat(F.lit(BASE), F.lit("entry/"), F.col("user_id").cast("string"), F.lit("/history/")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit(BASE), F.lit("bootstrap-static/")))
        .otherwise(F.concat(F.lit(BASE), F.lit("fixtures/"), F.lit("/"))).alias("url"),
    )
    pages = read_table(spark, sf, "pages").select((-F.col("page_id") - 1).alias("src_id"), "url")
    return built.unionByName(pages)


URLS_SQL = f"""
urls AS (
  SELECT event_id AS src_id,
         CASE event_type WHEN 'view' THEN '{BASE}element-summary/' || CAST(user_id AS STRING) || '/'
                         WHEN 'click' THEN '{BASE}entry/' || CAST(user_id AS STRING) || '/event/' || CAST(event_id % 38 + 1 AS STRING) || '/picks/'
                         WHEN 'signup' THEN '{BASE}entry/' || CAST(user_id AS STRING) || '/history/'
                         WHEN 'purchase' THEN '{BASE}bootstrap-static/'
                         ELSE '{BASE}fixtures//' END AS url
  FROM events
  UNION ALL
  SELECT -page_id - 1 AS src_id, url FROM pages
),
r AS (SELECT src_id, url, CASE WHEN starts_with(url, '{BASE}') THEN rtrim(substr(url, {len(BASE) + 1}), '/') ELSE url END AS rest FROM urls),
m AS (SELECT *, regexp_extract(rest, '^element-summary/([0-9]+)', 1) AS es,
             regexp_extract(rest, '^entry/([0-9]+)/event/([0-9]+)/picks', 1) AS pt,
             regexp_extract(rest, '^entry/([0-9]+)/event/([0-9]+)/picks', 2) AS pg,
             regexp_extract(rest, '^entry/([0-9]+)/history', 1) AS ht FROM r)"""


@proof(
    "request_key",
    "WITH " + URLS_SQL.strip() + """
SELECT src_id, url,
       CASE WHEN rest IN ('bootstrap-static', 'fixtures') THEN rest WHEN es <> '' THEN 'element-summary'
            WHEN pt <> '' OR ht <> '' THEN 'entry' WHEN contains(rest, '/') THEN split_part(rest, '/', 1) ELSE rest END AS endpoint,
       CASE WHEN rest IN ('bootstrap-static', 'fixtures') THEN rest WHEN es <> '' THEN 'element-summary:' || es
            WHEN pt <> '' THEN 'entry:' || pt || ':' || pg WHEN ht <> '' THEN 'entry:' || ht || ':history'
            ELSE replace(rest, '/', ':') END AS request_key
FROM m""",
)
def q_request_key(spark, sf):
    u = _urls(spark, sf)
    ep, key = keys.request_key(F.col("url"), BASE)
    return u.select("src_id", "url", ep.alias("endpoint"), key.alias("request_key"))


@proof(
    "bronze_path",
    """
SELECT event_id,
       CASE WHEN event_type = 'view'
            THEN '/bronze/element-summary/' || CAST(user_id AS STRING) || '/' || strftime(ts, '%Y-%m-%d') || '/' || strftime(ts, '%H%M%S') || '.json'
            ELSE '/bronze/' || replace(event_type, '/', '-') || '/' || strftime(ts, '%Y-%m-%dT%H-%M-%SZ') || '.json' END AS path
FROM events""",
)
def q_bronze_path(spark, sf):
    ev = read_table(spark, sf, "events")
    endpoint = F.when(F.col("event_type") == "view", F.lit("element-summary")).otherwise(F.col("event_type"))
    pid = F.when(F.col("event_type") == "view", F.col("user_id"))
    return ev.select("event_id", keys.bronze_path("/bronze", endpoint, F.col("ts"), pid).alias("path"))


@proof(
    "payload_sha",
    "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":{\"a\":1,\"b\":2}}') AS payload_sha256 FROM events",
)
def q_payload_sha(spark, sf):
    """The digest does not depend on white space or on the order of keys, at any depth."""
    ev = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    one = F.concat(F.lit('{"k":'), k, F.lit(',"z":{"a":1,"b":2}}'))
    other = F.concat(F.lit('{ "z": {"b": 2, "a": 1}, "k": '), k, F.lit("}"))
    return ev.select("event_id", keys.payload_digest(F.when(F.col("event_id") % 2 == 0, one).otherwise(other)).alias("payload_sha256"))


# ---------------------------------------------------------------- safe casts over event props
_NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _cast_inputs(df, k, eid):
    return [
        k.alias("s1"),
        F.concat(k, F.lit(".75")).alias("s2"),
        F.concat(F.lit("-"), k, F.lit(".5")).alias("s3"),
        F.when(eid % 6 == 0, F.lit("")).when(eid % 6 == 1, F.lit("abc")).when(eid % 6 == 2, F.concat(F.lit("1e"), k % 3))
        .when(eid % 6 == 3, F.concat(F.lit(" "), k, F.lit(" "))).when(eid % 6 == 4, F.lit("inf")).otherwise(F.lit("1_000")).alias("s4"),
        F.concat(F.lit("90071992547409"), F.lpad((eid % 100).cast("string"), 2, "0")).alias("s5"),
    ]


def _sql_int(s):
    return (f"CASE WHEN regexp_full_match(trim({s}), '[+-]?[0-9]+') THEN TRY_CAST(trim({s}) AS BIGINT) "
            f"WHEN regexp_full_match(trim({s}), '{_NUM}') AND isfinite(TRY_CAST(trim({s}) AS DOUBLE)) "
            f"THEN CAST(trunc(TRY_CAST(trim({s}) AS DOUBLE)) AS BIGINT) END")


def _sql_float(s):
    return (f"CASE WHEN regexp_full_match(trim({s}), '{_NUM}') THEN TRY_CAST(trim({s}) AS DOUBLE) "
            f"WHEN lower(trim({s})) IN ('inf', '+inf', 'infinity', '+infinity') THEN CAST('inf' AS DOUBLE) END")


@proof(
    "safe_casts",
    """
WITH c AS (
  SELECT event_id, ts, json_extract_string(props, '$.k') AS k FROM events
), s AS (
  SELECT event_id, ts, k AS s1, k || '.75' AS s2, '-' || k || '.5' AS s3,
         CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '1e' || CAST(CAST(k AS BIGINT) % 3 AS STRING)
              WHEN 3 THEN ' ' || k || ' ' WHEN 4 THEN 'inf' ELSE '1_000' END AS s4,
         '90071992547409' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS s5
  FROM c
)
SELECT event_id, """
    + ", ".join(f"{_sql_int(f's{i}')} AS i{i}, {_sql_float(f's{i}')} AS f{i}" for i in range(1, 6))
    + """,
       date_trunc('second', ts) AS t_utc, date_trunc('second', ts) - INTERVAL 2 HOUR AS t_offset, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS t_day
FROM s""",
)
def q_safe_casts(spark, sf):
    ev = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    s = ev.select("event_id", "ts", *_cast_inputs(ev, k, F.col("event_id")))
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return s.select(
        "event_id",
        *[x for i in range(1, 6) for x in (safe_int(f"s{i}").alias(f"i{i}"), safe_float(f"s{i}").alias(f"f{i}"))],
        safe_ts_utc(F.concat(base, F.lit("Z"))).alias("t_utc"),
        safe_ts_utc(F.concat(base, F.lit("+02:00"))).alias("t_offset"),
        safe_ts_utc(F.date_format("ts", "yyyy-MM-dd")).alias("t_day"),
    )


# ---------------------------------------------------------------- upsert and integrity
CUT = "2024-01-20 00:00:00"
EV_COLS = "user_id, event_type, event_id, ts, value, props"


def _upsert_frames(spark, sf):
    ev = read_table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value", "props")
    cut = F.lit(CUT).cast("timestamp_ntz")
    target = tables.latest_per_key(ev.where(F.col("ts") < cut), ["user_id", "event_type"], ["ts", "event_id"])
    source = ev.where(F.col("ts") >= cut)
    return target, source


@proof(
    "upsert_latest",
    f"""
WITH t AS (SELECT {EV_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
                                 FROM events WHERE ts < TIMESTAMP '{CUT}') AS a WHERE rn = 1),
     s AS (SELECT {EV_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
                                 FROM events WHERE ts >= TIMESTAMP '{CUT}') AS b WHERE rn = 1)
SELECT {EV_COLS} FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = t.user_id AND s.event_type = t.event_type)
UNION ALL SELECT {EV_COLS} FROM s""",
)
def q_upsert_latest(spark, sf):
    target, source = _upsert_frames(spark, sf)
    return tables.upsert(target, source, ["user_id", "event_type"], ["ts", "event_id"])


ALL_ROLES = ("teams", "element_types", "events", "players", "fixtures", "player_match_history", "player_future_fixtures")
XPTS_CTES = _w(FORM_SQL, UPCOMING_SQL, PERIODS_SQL, SIDES_SQL, XPTS_SQL, "player_expected_points AS (SELECT * FROM xpts)")


def _orphan_sql(child: str, fk: str, parent: str, pk: str) -> str:
    key = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in tables.KEYS[child])
    return f"SELECT '{child}.{fk}' AS fk, {key} AS child_key, CAST({fk} AS BIGINT) AS value FROM {child} WHERE {fk} NOT IN (SELECT {pk} FROM {parent})"


@proof("fk_orphans", role_cte(*ALL_ROLES) + ", " + XPTS_CTES + "\n" + "\nUNION ALL ".join(_orphan_sql(*k) for k in tables.FOREIGN_KEYS))
def q_fk_orphans(spark, sf):
    """All nine foreign keys."""
    r = _roles(spark, sf, *ALL_ROLES)
    r["player_expected_points"] = _xpts_frame(spark, sf)
    return tables.all_orphans(r)


#: A column of each table that the second batch of the store proof changes.
CHANGED = {"teams": "strength", "element_types": "squad_select", "events": "name", "players": "minutes", "fixtures": "team_h_difficulty",
           "player_match_history": "minutes", "player_future_fixtures": "difficulty", "player_expected_points": "xmins"}


def _store_proof(table: str):
    """Two upserts into a fresh store: all rows; then every third key twice, of which the later row wins."""
    columns = [c for c in tables.SCHEMAS[table].names if c != tables.STAMP[table]]
    keys_, col = tables.KEYS[table], CHANGED[table]
    third = f"{keys_[-1]} % 3 = 0"
    new = f"concat({col}, '!')" if table == "events" else f"{col} + 1"
    listed = ", ".join(columns)
    changed = listed.replace(f"{col}", f"CASE WHEN {third} THEN {new} ELSE {col} END AS {col}") if listed.count(col) == 1 else None
    if changed is None:
        changed = ", ".join(f"CASE WHEN {third} THEN {new} ELSE {col} END AS {col}" if c == col else c for c in columns)
    kinds = {f.name: f.dataType.simpleString().upper().replace("TIMESTAMP_NTZ", "TIMESTAMP") for f in tables.SCHEMAS[table]}
    typed = ", ".join(f"CAST({c} AS {kinds[c]}) AS {c}" for c in columns)
    ctes = role_cte(*ALL_ROLES) + (", " + XPTS_CTES if table == "player_expected_points" else "")

    @proof(f"store_{table}", f"{ctes}\nSELECT {typed} FROM (SELECT {changed} FROM {table}) AS c")
    def q(spark, sf):
        from leagueflow.plans.proof_learn import _scratch

        rows = _xpts_frame(spark, sf) if table == "player_expected_points" else role(spark, sf, table)
        store = tables.TableStore(spark, _scratch(spark, f"store-{table}"))
        store.upsert(table, rows, keys_, as_of=AS_OF, orphans="ignore")
        again = rows.where(third)
        other = F.lit("older") if table == "events" else F.lit(-5)
        older = again.withColumn(col, other.cast(rows.schema[col].dataType)).withColumn("_o", F.lit(1))
        newer = again.withColumn(col, F.expr(new)).withColumn("_o", F.lit(2))
        store.upsert(table, newer.unionByName(older), ["_o"], as_of=AS_OF, orphans="ignore")
        return store.read(table).drop(tables.STAMP[table])

    return q


for _t in CHANGED:
    _store_proof(_t)


# ---------------------------------------------------------------- incremental selection
LAST_FETCH_SQL = """
lf AS (SELECT TRY_CAST(split_part(request_key, ':', 2) AS BIGINT) AS player_id, max(fetched_at_utc) AS last_fetched
       FROM meta_ingestions WHERE starts_with(request_key, 'element-summary:')
       GROUP BY TRY_CAST(split_part(request_key, ':', 2) AS BIGINT))"""


def _sel_sql(cands: str, since_h: float, max_age_h: float | None) -> str:
    due = f"lf.last_fetched IS NULL OR lf.last_fetched < TIMESTAMP '{AS_OF}' - INTERVAL {int(since_h)} HOUR"
    if max_age_h:
        due += f" OR lf.last_fetched < TIMESTAMP '{AS_OF}' - INTERVAL {int(max_age_h)} HOUR"
    return (role_cte("players", "meta_ingestions") + ", " + _w(LAST_FETCH_SQL, cands)
            + f"\nSELECT c.player_id, c.rank FROM c LEFT JOIN lf ON c.player_id = lf.player_id WHERE {due}")


ALL_C = "c AS (SELECT id AS player_id, CAST(id AS BIGINT) AS rank FROM players)"
TOP_C = ("c AS (SELECT id AS player_id, CAST(row_number() OVER (ORDER BY total_points DESC NULLS LAST, id) AS BIGINT) AS rank "
         "FROM players ORDER BY total_points DESC NULLS LAST, id LIMIT 250)")


def _logged(spark, sf) -> tables.TableStore:
    """A store whose log has come in parts, the later first and one of them twice."""
    from leagueflow.plans.proof_learn import _scratch

    store = tables.TableStore(spark, _scratch(spark, "log"))
    log, cut = role(spark, sf, "meta_ingestions"), F.lit(CUT).cast("timestamp_ntz")
    parts = {"late": log.where(F.col("fetched_at_utc") >= cut), "early": log.where(F.col("fetched_at_utc") < cut)}
    for name in ("late", "early", "late"):
        store.log_fetches(parts[name], part=name)
    return store


def _sel(spark, sf, n, **kw):
    cands = incremental.top_candidates(role(spark, sf, "players"), n)
    return incremental.select_incremental(cands, _logged(spark, sf).read("last_fetches"), AS_OF, **kw)


@proof("select_incremental", _sel_sql(ALL_C, 36, None))
def q_select_incremental(spark, sf):
    return _sel(spark, sf, None, since_hours=36)


@proof("select_incremental_max_age", _sel_sql(ALL_C, 240, 12))
def q_select_incremental_max_age(spark, sf):
    return _sel(spark, sf, None, since_hours=240, max_age_hours=12)


@proof("select_top_incremental", _sel_sql(TOP_C, 36, None))
def q_select_top_incremental(spark, sf):
    return _sel(spark, sf, 250, since_hours=36)


@proof("select_force", role_cte("players") + ", " + TOP_C + "\nSELECT player_id, rank FROM c")
def q_select_force(spark, sf):
    return _sel(spark, sf, 250, since_hours=36, force=True)


@proof("last_fetch", role_cte("meta_ingestions") + ", " + LAST_FETCH_SQL.strip() + "\nSELECT * FROM lf WHERE player_id IS NOT NULL")
def q_last_fetch(spark, sf):
    return incremental.last_fetch(_logged(spark, sf).read("last_fetches"))


@proof(
    "log_append",
    role_cte("meta_ingestions")
    + "SELECT endpoint, run_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT request_key) AS BIGINT) AS keys, "
    "CAST(count(DISTINCT url) AS BIGINT) AS urls FROM meta_ingestions GROUP BY endpoint, run_id",
)
def q_log_append(spark, sf):
    store = _logged(spark, sf)
    store.init()  # leaves what exists alone
    return store.read("meta_ingestions").groupBy("endpoint", "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("request_key").alias("keys"), F.countDistinct("url").alias("urls")
    )


# ---------------------------------------------------------------- quality
def _dq_tables(spark, sf):
    r = _roles(spark, sf, "teams", "element_types", "events", "players", "fixtures", "player_match_history",
               "player_future_fixtures")
    r["player_expected_points"] = _xpts_frame(spark, sf)
    return r


def _dq_sql_rows() -> str:
    q = quality.Rules()
    cnt = lambda t: f"SELECT '{t}' AS t, CAST(count(*) AS BIGINT) AS n FROM {t}"
    counts = " UNION ALL ".join(cnt(t) for t in quality.CORE_TABLES)
    nulls = []
    for t, c, sev in quality.NULL_CHECKS:
        fail = "n > 0" if sev == "error" else "FALSE"
        nulls.append(
            f"SELECT 'null_pct' AS \"check\", '{t}.{c}' AS subject, '{sev}' AS severity, n, "
            f"floor(CAST(100.0 AS DOUBLE) * CAST(n AS DOUBLE) / CAST(total AS DOUBLE) * {D(100.0)} + {D(0.5)}) / {D(100.0)} AS pct, "
            f"({fail}) AS failed FROM (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n FROM {t}) AS a WHERE total > 0"
        )
    pmh = "player_match_history"
    return f"""
counts AS ({counts}),
report AS (
  SELECT 'count' AS "check", t AS subject, 'info' AS severity, n, CAST(NULL AS DOUBLE) AS pct, FALSE AS failed FROM counts
  UNION ALL SELECT 'row_count_range', 'players', 'warn', n, NULL, n <= {q.min_players} FROM counts WHERE t = 'players'
  UNION ALL SELECT 'row_count_range', 'fixtures', 'warn', n, NULL, NOT (n BETWEEN {q.fixtures_lo} AND {q.fixtures_hi}) FROM counts WHERE t = 'fixtures'
  UNION ALL {' UNION ALL '.join(nulls)}
  UNION ALL SELECT 'minutes_range', '{pmh}.minutes', 'error', n, NULL, n > 0
            FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM {pmh} WHERE minutes IS NOT NULL AND (minutes < {q.minutes_lo} OR minutes > {q.minutes_hi})) AS m
  UNION ALL SELECT 'points_range', '{pmh}.total_points', 'warn', n, NULL, n > 0
            FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM {pmh} WHERE total_points IS NOT NULL AND (total_points < {q.points_lo} OR total_points > {q.points_hi})) AS m
  UNION ALL SELECT 'orphans', 'players.team_id->teams.id', 'error', n, NULL, n > 0
            FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM players p WHERE p.team_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM teams t WHERE t.id = p.team_id)) AS o
  UNION ALL SELECT 'orphans', 'fixtures.event_id->events.id', 'error', n, NULL, n > 0
            FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM fixtures f WHERE f.event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM events e WHERE e.id = f.event_id)) AS o
)"""


DQ_ORACLE_PREFIX = (
    role_cte("teams", "element_types", "events", "players", "fixtures", "player_match_history", "player_future_fixtures")
    + ", " + _w(FORM_SQL, UPCOMING_SQL, PERIODS_SQL, SIDES_SQL, XPTS_SQL, "player_expected_points AS (SELECT * FROM xpts)", _dq_sql_rows())
)


@proof("dq_report", DQ_ORACLE_PREFIX + "\nSELECT * FROM report")
def q_dq_report(spark, sf):
    return quality.quality_report(spark, _dq_tables(spark, sf))


@proof(
    "dq_gate",
    DQ_ORACLE_PREFIX
    + """
SELECT lvl AS level, CAST(sum(CASE WHEN failed AND severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       CAST(sum(CASE WHEN failed AND severity = 'warn' THEN 1 ELSE 0 END) AS BIGINT) AS warnings,
       CASE lvl WHEN 'hard' THEN sum(CASE WHEN failed AND severity = 'error' THEN 1 ELSE 0 END) > 0
                WHEN 'strict' THEN sum(CASE WHEN failed AND severity IN ('error', 'warn') THEN 1 ELSE 0 END) > 0
                ELSE FALSE END AS should_fail
FROM report CROSS JOIN (SELECT 'hard' AS lvl UNION ALL SELECT 'strict' UNION ALL SELECT 'warn') AS l
GROUP BY lvl""",
)
def q_dq_gate(spark, sf):
    return quality.gate_levels(quality.quality_report(spark, _dq_tables(spark, sf)))


@proof(
    "dq_before_publish",
    DQ_ORACLE_PREFIX
    + """
SELECT report.*, NOT bool_or(failed AND severity = 'error') OVER (PARTITION BY split_part(subject, '.', 1)) AS published FROM report
WHERE "check" NOT IN ('row_count_range', 'orphans', 'table_exists')""",
)
def q_dq_before_publish(spark, sf):
    """The figures that the writing passes observe, and whether the table has its rows afterwards: one that fails has none."""
    from leagueflow.plans.proof_learn import _scratch

    store = tables.TableStore(spark, _scratch(spark, "publish"))
    gate = quality.BatchGate(spark, "hard")
    out = None
    for table, rows in _dq_tables(spark, sf).items():
        with contextlib.suppress(quality.QualityError):
            store.upsert(table, rows, tables.KEYS[table], as_of=AS_OF, orphans="ignore", check=gate)
        part = gate.reports[table].withColumn("published", F.lit(not store.read(table).isEmpty()))
        out = part if out is None else out.unionByName(part)
    return out


@proof(
    "dq_missing_table",
    DQ_ORACLE_PREFIX
    + """
SELECT * FROM report WHERE subject NOT IN ('teams', 'players.team_id->teams.id')
UNION ALL SELECT 'table_exists', 'teams', 'error', NULL, NULL, TRUE""",
)
def q_dq_missing_table(spark, sf):
    return quality.quality_report(spark, {k: v for k, v in _dq_tables(spark, sf).items() if k != "teams"})


@proof(
    "dq_samples",
    role_cte("player_match_history")
    + """
SELECT player_id, fixture_id_effective, minutes, total_points FROM player_match_history
WHERE (minutes IS NOT NULL AND (minutes < 0 OR minutes > 130)) OR (total_points IS NOT NULL AND (total_points < -10 OR total_points > 40))
ORDER BY player_id, fixture_id_effective LIMIT 10""",
)
def q_dq_samples(spark, sf):
    return quality.sample_anomalies(role(spark, sf, "player_match_history"))


# ---------------------------------------------------------------- squad facts
@proof(
    "squad_team_counts",
    role_cte("squads", "squad_players")
    + "SELECT s.squad_id, p.team_id, CAST(count(*) AS BIGINT) AS n_players FROM squads s JOIN squad_players p ON s.player_id = p.id GROUP BY s.squad_id, p.team_id",
)
def q_squad_team_counts(spark, sf):
    r = _roles(spark, sf, "squads", "squad_players")
    return sq.squad_team_counts(r["squads"], r["squad_players"])


@proof(
    "squad_positions",
    role_cte("squads", "squad_players")
    + """
SELECT s.squad_id, """
    + ", ".join(
        f"CAST(sum(CASE WHEN p.element_type_id = {r} THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
        for r, n in zip((1, 2, 3, 4), ("n_gkp", "n_def", "n_mid", "n_fwd"))
    )
    + " FROM squads s JOIN squad_players p ON s.player_id = p.id GROUP BY s.squad_id",
)
def q_squad_positions(spark, sf):
    r = _roles(spark, sf, "squads", "squad_players")
    return sq.squad_positions(r["squads"], r["squad_players"])


@proof(
    "squad_value",
    role_cte("squads", "squad_players", "squad_bank")
    + """
SELECT b.squad_id, CAST(b.bank_tenths + coalesce(c.cost, 0) AS BIGINT) AS budget_tenths
FROM squad_bank b LEFT JOIN (SELECT s.squad_id, sum(p.now_cost) AS cost FROM squads s JOIN squad_players p ON s.player_id = p.id
                             GROUP BY s.squad_id) AS c ON b.squad_id = c.squad_id""",
)
def q_squad_value(spark, sf):
    r = _roles(spark, sf, "squads", "squad_players", "squad_bank")
    return sq.squad_value(r["squads"], r["squad_players"], r["squad_bank"])
