import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import budget
from tessera.plans import catalogue
from tessera.sources.layout import Layout, declare, fill, stored_as

FOLDER = "/root/testdata/sf0.001"
LAYOUT = Layout("id bigint, repo string, n int", ("repo",))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.select("id", "repo", "n").collect()), key=repr)


def folders(df):
    return {f.split("repo=")[1].split("/")[0] for f in df.inputFiles()}


def test_declaring_twice_changes_nothing(spark, tmp_path):
    tables = {"layout_a": LAYOUT, "layout_b": Layout("id bigint, n int", key="id", buckets=4)}
    assert declare(spark, tables, str(tmp_path)) == ["layout_a", "layout_b"]
    fill(spark, "layout_a", LAYOUT, spark.createDataFrame([(1, "x", 2, "extra")], "id long, repo string, n int, other string"))
    assert declare(spark, tables, str(tmp_path)) == [] and rows(spark.table("layout_a")) == [(1, "x", 2)]
    assert spark.table("layout_b").count() == 0
    with pytest.raises(Exception, match="n"):
        fill(spark, "layout_a", LAYOUT, spark.createDataFrame([(1, "x")], "id long, repo string"))


def test_partitions_are_replaced_alone(spark, tmp_path):
    declare(spark, {"layout_c": LAYOUT}, str(tmp_path))
    put = lambda data, replace: fill(spark, "layout_c", LAYOUT, spark.createDataFrame(data, "id long, repo string, n int"), replace)
    put([(1, "a", 1), (2, "b", 1), (3, None, 1), (4, "x/y = 'z'", 1), (None, "a", None)], False)
    before = {f for f in spark.table("layout_c").inputFiles() if "repo=a" not in f}
    put([(5, "a", 2)], True)
    assert rows(spark.table("layout_c")) == sorted([(5, "a", 2), (2, "b", 1), (3, None, 1), (4, "x/y = 'z'", 1)], key=repr)
    assert {f for f in spark.table("layout_c").inputFiles() if "repo=a" not in f} == before
    put([], True)
    assert spark.table("layout_c").count() == 4
    put([(6, None, 2), (6, None, 2)], True)
    assert rows(spark.table("layout_c").filter("repo is null")) == [(6, None, 2), (6, None, 2)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_filters_and_joins_choose_folders(spark):
    table = stored_as(spark.range(2000).select("id", F.concat(F.lit("r"), F.col("id") % 10).alias("repo"), F.lit(1).alias("n")), LAYOUT)
    assert folders(table) == {f"r{k}" for k in range(10)}
    one = plan(table.filter("repo = 'r3'").select("id"))
    assert re.search(r"PartitionFilters: \[isnotnull\(repo.*repo#\d+ = r3", one)
    wanted = spark.createDataFrame([("r1", 1), ("r2", 2), ("r9", 1)], "repo string, region int").filter("region = 1").select("repo")
    joined = table.join(F.broadcast(wanted), "repo")
    assert joined.count() == 400 and "dynamicpruning" in plan(joined)
    assert "dynamicpruning" in plan(catalogue.QUERIES["repository_scan"](spark, FOLDER))


def test_buckets_need_no_shuffle(spark):
    got = catalogue.QUERIES["bucketed_join"](spark, FOLDER)
    assert "Exchange" not in plan(got) and "SortMergeJoin" in plan(got)


def test_a_hot_group_becomes_many_lists(spark):
    data = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") * 3).alias("o"), F.lit("f").alias("x"))
    data = data.unionByName(spark.createDataFrame([(None, 1, "f"), ("hot", None, "f")], "g string, o long, x string"))
    got = {(r["g"], r["part"]): [m["o"] for m in r["members"]] for r in budget.lists(data, "g", "o", ["x"], 100).collect()}
    want = {}
    for i in range(5000):
        want.setdefault("hot" if i % 3 else f"g{i % 7}", []).append(i * 3)
    assert got == {(g, k // 100): o[k : k + 100] for g, o in want.items() for k in range(0, len(o), 100)}
    assert budget.lists(data.limit(0), "g", "o", ["x"]).count() == 0
