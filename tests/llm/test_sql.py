"""The operators that SQL can express give DuckDB's rows."""

import os

import duckdb
import pytest

from tessera.llm import registry

from .helpers import FOLDER


def view(con, name):
    path = f"{FOLDER}/{name}.parquet"
    con.sql(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_operator_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        view(con, t)
    want, got = con.sql(registry.ORACLES[name]), registry.QUERIES[name](spark, FOLDER)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect())
