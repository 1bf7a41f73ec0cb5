"""Every query that SQL can express gives DuckDB's rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import structure as operators
from tessera.plans import catalogue, structure
from tessera.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalogue.ORACLES[name])
    columns, rows = rows_of(got.columns, got.collect())
    assert rows, "a query without rows proves nothing"
    assert (columns, rows) == rows_of(list(want.columns), want.fetchall())


def test_merges_occur_and_fail_to(spark):
    """Modules that merge, that miss the share exactly or by a tie, and that are too large, many of each."""
    rows = catalogue.QUERIES["module_merge"](spark, "/root/testdata/sf0.01").count()
    edges, modules = structure._modules(spark, "/root/testdata/sf0.01")
    counts = operators.cross_edges(edges, modules).groupBy("module").agg(F.sum("edges").alias("total"), F.max("edges").alias("best"), F.sort_array(F.collect_list("edges"), asc=False).alias("all"))
    sized = counts.join(modules.groupBy("module").count(), "module").filter("total >= 2")
    small = sized.filter("count <= 3")
    assert rows > 300 and small.filter("5 * best > 3 * total").count() == rows
    assert small.filter("5 * best = 3 * total").count() > 30 and small.filter("size(all) > 1 and all[0] = all[1]").count() > 100 and sized.filter("count = 4 and 5 * best > 3 * total").count() > 300


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)


def test_fallback_ignores_copies_of_the_question(spark, tmp_path):
    """Stored copies of the question reach any threshold; the fallback's SQL has none."""
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows.unionByName(rows.withColumn("vec_id", F.col("vec_id") + 1_000_000)).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("qa_fallback", "qa_hierarchical"):
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)), con.sql(catalogue.ORACLES[name])
        assert rows_of(got.columns, got.collect()) == rows_of(list(want.columns), want.fetchall())
