"""Tables under declared layouts: scans that choose folders, joins by buckets, replaced partitions, lists of bounded parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.budget import lists
from tessera.plans.registry import query
from tessera.sources.layout import Layout, declare, fill, shared_folder, stored_as
from tessera.sources.tables import table

FILES = Layout("doc_id bigint, lang string, n_chars bigint, source string", ("source",))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"), "source")


@query("""
SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN nation ON source = 'src' || n_nationkey WHERE n_regionkey = 2 GROUP BY source
""")
def repository_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the repositories of one region: the filter is on the other table, and only those repositories' folders are read."""
    wanted = table(spark, folder, "nation").filter("n_regionkey = 2").select(F.concat(F.lit("src"), "n_nationkey").alias("source"))
    rows = stored_as(_files(spark, folder), FILES).join(wanted, "source")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


@query("""
SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS findings, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS quantity
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus
""")
def bucketed_join(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews and their findings, both dealt by the review: neither the join nor the grouping shuffles."""
    reviews = stored_as(table(spark, folder, "orders"), Layout("o_orderkey bigint, o_orderstatus string", key="o_orderkey", buckets=16))
    findings = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("l_quantity"))
    findings = stored_as(findings, Layout("l_orderkey bigint, l_quantity bigint", key="l_orderkey", buckets=16))
    rows = reviews.hint("merge").join(findings, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_orderkey").alias("findings"), F.coalesce(F.sum("l_quantity"), F.lit(0)).alias("quantity"))


@query("""
WITH batch AS (SELECT doc_id, 'new' AS lang, n_chars + 1 AS n_chars, source FROM documents WHERE doc_id % 3 = 0 AND CAST(substr(source, 4) AS INTEGER) % 2 = 1)
SELECT doc_id, lang, n_chars, source FROM batch UNION ALL SELECT doc_id, lang, n_chars, source FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM batch)
""")
def replaced_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Some repositories indexed anew: their partitions are replaced, all others stay as they were written."""
    name = f"files_{uuid.uuid4().hex}"
    declare(spark, {name: FILES}, shared_folder(spark))
    rows = _files(spark, folder)
    fill(spark, name, FILES, rows)
    batch = rows.filter("doc_id % 3 = 0 and cast(substr(source, 4) as int) % 2 = 1")
    fill(spark, name, FILES, batch.withColumn("lang", F.lit("new")).withColumn("n_chars", F.col("n_chars") + 1), replace=True)
    return spark.table(name).select("doc_id", "lang", "n_chars", "source")


@query("""
WITH placed AS (SELECT source, doc_id, lang, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS BIGINT) AS part FROM documents)
SELECT source, part, count(*) AS files, string_agg(doc_id || ':' || lang, ',' ORDER BY doc_id) AS members FROM placed GROUP BY source, part
""")
def module_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each module's files in order, in lists of twenty, so that no row grows with the module."""
    rows = lists(table(spark, folder, "documents").select("source", "doc_id", "lang"), "source", "doc_id", ["lang"], 20)
    members = F.array_join(F.transform("members", lambda m: F.concat(m["doc_id"], F.lit(":"), m["lang"])), ",")
    return rows.select("source", "part", F.size("members").cast("long").alias("files"), members.alias("members"))
