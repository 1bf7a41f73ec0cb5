"""Content-hash deltas and mutations as set operations over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and action: insert, delete or touch. Repeated keys of either side count once. One shuffle on the keys."""
    old = stored.select(*keys).distinct().withColumn("_old", F.lit(True))
    fresh = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("touch")
    return old.join(fresh, keys, "full_outer").select(*keys, action.alias("action"))


def apply_diff(stored: DataFrame, new: DataFrame, keys: list[str], touched: dict) -> DataFrame:
    """The table after the delta: orphans go, kept rows take the `touched` values, new rows are added once."""
    kept = stored.join(new.select(*keys).distinct(), keys, "left_semi").withColumns({c: F.lit(v) for c, v in touched.items()})
    added = new.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti").withColumns({c: F.lit(v) for c, v in touched.items()})
    return kept.select(*stored.columns).unionByName(added.select(*stored.columns))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last writer wins: of the rows of a key, the first by `order` stays."""
    latest = Window.partitionBy(*keys).orderBy(*order)
    return current.unionByName(incoming).withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def with_is_new(incoming: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    known = current.select(*keys).distinct().withColumn("_known", F.lit(True))
    return incoming.join(known, keys, "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, do nothing on conflict."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys).distinct(), keys, "left_anti"))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_owned(rows: DataFrame, requests: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, keys that went) after `requests` (key, owner): a row goes only for its own owner; null owners own nothing."""
    gone = rows.join(requests.select(key, owner).distinct(), [key, owner], "left_semi").select(key)
    return delete(rows, gone, [key]), gone


def set_null(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`rows` whose reference `key` is null where its target is among `gone` (the same column)."""
    lost = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(lost, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*rows.columns)


def first_row(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_n = 1").drop("_n")


def transitions(runs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, status, indexed_commit) after all runs (key, order, ok, commit): INDEXED or FAILED by the last one, INDEXING while its outcome (ok) is null.

    The pointer is the commit of the last run that succeeded, so a failure leaves it where it was.
    """
    last = F.max_by(F.struct("ok"), order)["ok"]
    status = F.when(last.isNull(), "INDEXING").when(last, "INDEXED").otherwise("FAILED")
    return runs.groupBy(key).agg(status.alias("status"), F.max_by(F.when(F.col("ok"), F.col("commit")), F.when(F.col("ok"), F.col(order))).alias("indexed_commit"))
