"""The queries that SQL can express, against DuckDB."""

import math

import duckdb
import pytest

from leagueflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    norm = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(norm, r)) for r in cur.fetchall()), key=repr)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
