"""Role views: the league model's silver tables expressed over the driver's
generic tables (TPC-H-like star schema plus an event log).

Each role is one SQL SELECT with ``{table}`` placeholders. Spark runs it with
``spark.sql(text, table=DataFrame)`` (no global temp views, so sessions that
read several scale factors never collide), and the DuckDB oracle inlines the
same text as a CTE over its pre-registered views. One text, two engines: the
oracle can only disagree with Spark about the operators under test.

Every role reads whole tables; no role samples, caps or filters rows by id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Fixed parameters of the mapping (not reference values).
BASE_YEAR = 1995          # gameweek 1 = January 1995
FINISHED_BEFORE_YEAR = 2000  # fixtures and gameweeks before 2000 are finished
AS_OF = "2024-01-31 00:00:00"  # clock for incremental selection over the event log

_GW = f"((year({{d}}) - {BASE_YEAR}) * 12 + month({{d}}))"


def gameweek_sql(date_col: str) -> str:
    return _GW.format(d=date_col)


ROLE_SQL: dict[str, str] = {
    # teams <- nation
    "teams": """
SELECT CAST(n_nationkey AS BIGINT) AS id,
       n_name AS name,
       concat('T', CAST(n_nationkey AS STRING)) AS short_name,
       CAST(n_regionkey + 1 AS INT) AS strength
FROM {nation}""",
    # positions <- region
    "element_types": """
SELECT CAST(r_regionkey AS BIGINT) AS id,
       substr(r_name, 1, 3) AS singular_name_short,
       r_name AS singular_name,
       CAST(r_regionkey + 1 AS INT) AS squad_select
FROM {region}""",
    # gameweeks <- months of orders
    "events": f"""
SELECT CAST(gw AS BIGINT) AS id,
       concat('GW', CAST(gw AS STRING)) AS name,
       min(o_orderdate) AS deadline_time,
       (max(yr) < {FINISHED_BEFORE_YEAR}) AS finished,
       (gw = {(FINISHED_BEFORE_YEAR - BASE_YEAR) * 12}) AS is_current,
       (gw = {(FINISHED_BEFORE_YEAR - BASE_YEAR) * 12 + 1}) AS is_next
FROM (SELECT {gameweek_sql('o_orderdate')} AS gw, year(o_orderdate) AS yr, o_orderdate FROM {{orders}}) AS o
GROUP BY gw""",
    # players <- customers (a few without team, a few with an unknown team)
    "players": """
SELECT c_custkey AS id,
       c_name AS web_name,
       concat('F', CAST(c_custkey AS STRING)) AS first_name,
       c_name AS second_name,
       CAST(CASE WHEN c_custkey % 101 = 100 THEN NULL
                 WHEN c_custkey % 211 = 0 THEN 99
                 ELSE c_nationkey END AS BIGINT) AS team_id,
       CAST(CASE WHEN c_custkey % 157 = 3 THEN NULL ELSE 1 + c_custkey % 4 END AS BIGINT) AS element_type_id,
       CAST(40 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 91 AS INT) AS now_cost,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'a' WHEN 'BUILDING' THEN 'a'
                         WHEN 'FURNITURE' THEN 'd' WHEN 'HOUSEHOLD' THEN 'a '
                         WHEN 'MACHINERY' THEN 'I' END AS status,
       CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 3421 AS INT) AS minutes,
       CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 250 AS INT) AS total_points,
       CAST(c_custkey % 1000 AS DOUBLE) / 10 AS selected_by_percent,
       CAST(c_custkey % 97 AS DOUBLE) / 10 AS form,
       CASE WHEN c_custkey % 13 = 5 THEN NULL ELSE CAST(c_custkey % 83 AS DOUBLE) / 10 END AS points_per_game,
       CAST(c_custkey % 7 AS DOUBLE) / 10 AS expected_goals,
       CAST(c_custkey % 5 AS DOUBLE) / 10 AS expected_assists,
       CAST(c_custkey % 11 AS DOUBLE) / 10 AS expected_goal_involvements,
       CAST(c_custkey % 9 AS DOUBLE) / 10 AS expected_goals_conceded,
       (SELECT max(o_orderdate) FROM {orders}) AS ingested_at_utc
FROM {customer}""",
    # fixtures <- orders (home side from the customer, away side derived; some undated gameweeks)
    "fixtures": f"""
SELECT o_orderkey AS id,
       CAST(CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {gameweek_sql('o_orderdate')} END AS BIGINT) AS event_id,
       CAST(o_custkey % 25 AS BIGINT) AS team_h,
       CAST((o_custkey + 1 + o_orderkey % 24) % 25 AS BIGINT) AS team_a,
       CASE WHEN o_orderkey % 89 = 1 THEN NULL ELSE o_orderdate END AS kickoff_time,
       CASE WHEN year(o_orderdate) < {FINISHED_BEFORE_YEAR} THEN TRUE
            WHEN o_orderstatus = 'F' THEN TRUE
            WHEN o_orderstatus = 'O' THEN FALSE END AS finished,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS team_h_difficulty,
       CAST(6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS INT) AS team_a_difficulty
FROM {{orders}}""",
    # match history <- orders (one game per order; some games lack a fixture id)
    "player_match_history": f"""
SELECT o_custkey AS player_id,
       CASE WHEN o_orderkey % 10 = 3 THEN -o_orderkey ELSE o_orderkey END AS fixture_id_effective,
       CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderkey END AS fixture_id,
       CAST(CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {gameweek_sql('o_orderdate')} END AS BIGINT) AS event_id,
       CAST(o_orderkey % 137 AS INT) AS minutes,
       CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) - 2 AS INT) AS total_points,
       CAST(o_orderkey % 3 AS INT) AS goals_scored,
       CAST(o_custkey % 2 AS INT) AS assists,
       CAST(o_orderkey % 2 AS INT) AS clean_sheets,
       CAST(o_orderkey % 4 AS INT) AS goals_conceded,
       CAST(o_orderkey % 11 AS DOUBLE) / 10 AS expected_goals,
       CAST(o_orderkey % 7 AS DOUBLE) / 10 AS expected_assists,
       CAST(o_orderkey % 13 AS DOUBLE) / 10 AS expected_goal_involvements,
       CAST(o_orderkey % 5 AS DOUBLE) / 10 AS expected_goals_conceded
FROM {{orders}}""",
    # upcoming fixtures per player <- unfinished orders of the customer
    "player_future_fixtures": f"""
SELECT o_custkey AS player_id,
       o_orderkey AS fixture_id,
       CAST({gameweek_sql('o_orderdate')} AS BIGINT) AS event_id,
       (o_orderkey % 2 = 0) AS is_home,
       CAST((o_custkey + 1 + o_orderkey % 24) % 25 AS BIGINT) AS opponent_team,
       o_orderdate AS kickoff_time,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS difficulty
FROM {{orders}}
WHERE year(o_orderdate) >= {FINISHED_BEFORE_YEAR} AND o_orderstatus <> 'F'""",
    # squad world: tradeable players <- parts
    "squad_players": """
SELECT p_partkey AS id,
       p_name AS web_name,
       CAST(1 + p_size % 4 AS BIGINT) AS element_type_id,
       CAST(p_partkey % 20 AS BIGINT) AS team_id,
       CAST(40 + CAST(floor(p_retailprice * 10) AS BIGINT) % 91 AS BIGINT) AS now_cost
FROM {part}""",
    # squad world: expected points per (part, ship year), two decimals
    "squad_scores": f"""
SELECT l_partkey AS player_id,
       CAST(year(l_shipdate) - {BASE_YEAR - 1} AS BIGINT) AS event_id,
       CAST(floor(sum(l_quantity) * 10 / count(*)) AS DOUBLE) / 100 AS xpts
FROM {{lineitem}}
GROUP BY l_partkey, year(l_shipdate)""",
    # squad world: 15-man squads <- the parts each supplier ships most (2/5/5/3 by position)
    "squads": """
SELECT squad_id, player_id,
       CAST(row_number() OVER (PARTITION BY squad_id ORDER BY element_type_id, rk) AS INT) AS slot
FROM (
  SELECT squad_id, player_id, element_type_id,
         row_number() OVER (PARTITION BY squad_id, element_type_id ORDER BY n DESC, player_id) AS rk
  FROM (
    SELECT l.l_suppkey AS squad_id, l.l_partkey AS player_id, CAST(1 + p.p_size % 4 AS BIGINT) AS element_type_id,
           count(*) AS n
    FROM {lineitem} AS l JOIN {part} AS p ON l.l_partkey = p.p_partkey
    GROUP BY l.l_suppkey, l.l_partkey, p.p_size
  ) AS c
) AS r
WHERE rk <= CASE element_type_id WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 5 ELSE 3 END""",
    # squad world: money in the bank, tenths
    "squad_bank": """
SELECT s_suppkey AS squad_id, CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 30 AS BIGINT) AS bank_tenths
FROM {supplier}""",
    # ingestion log <- event stream (one fetch per event, keyed by user)
    "meta_ingestions": """
SELECT event_id AS id,
       concat('run-', CAST(CAST(floor(event_id / 500) AS BIGINT) AS STRING)) AS run_id,
       concat('element-summary:', CAST(user_id AS STRING)) AS request_key,
       'element-summary' AS endpoint,
       concat('https://fantasy.example/api/element-summary/', CAST(user_id AS STRING), '/') AS url,
       ts AS fetched_at_utc,
       CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INT) AS http_status
FROM {events}""",
}

# Tables that grow with the data and that a role joins: hashed by key within tasks (a row or few per key), never broadcast
# because their files compress well.
HASHED_BY_KEY = {"squads": ("part",)}

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def role_tables(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(ROLE_SQL[name])))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The role view as a Spark DataFrame over the parquet tables in ``sf_dir``."""
    text = ROLE_SQL[name]
    frames = {t: read_table(spark, sf_dir, t) for t in role_tables(name)}
    frames |= {t: frames[t].hint("shuffle_hash") for t in HASHED_BY_KEY.get(name, ())}
    return spark.sql(text, **frames)


def role_cte(*names: str) -> str:
    """``WITH`` clause defining the given roles for DuckDB (tables are views)."""
    parts = []
    for n in names:
        text = ROLE_SQL[n]
        body = _PLACEHOLDER.sub(lambda m: m.group(1), text).replace("{{", "{").replace("}}", "}")
        parts.append(f"{n} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
