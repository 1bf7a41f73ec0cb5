"""Delta indexing, upserts, chunks and hash-tree queries over `documents`, `events` and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import delta, structure
from tessera.operators.chunking import line_windows
from tessera.operators.constraints import Check, Reference, Required, Unique, violations
from tessera.plans.registry import query
from tessera.sources.tables import table

VERSIONS = """
old AS (SELECT source || '/' || doc_id || '.' || lang AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT source || '/' || doc_id || '.' || lang AS path, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 2)
"""


def versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the files: every tenth is added, one tenth modified, one tenth removed."""
    docs = table(spark, folder, "documents").withColumn("path", F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang"))
    old = docs.filter("doc_id % 10 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    text = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return old, docs.filter("doc_id % 10 <> 2").select("path", F.sha2(text, 256).alias("hash"))


@query(f"""WITH {VERSIONS}
SELECT coalesce(o.path, n.path) AS path, coalesce(o.hash, n.hash) AS hash, CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN 'delete' ELSE 'touch' END AS action
FROM old o FULL JOIN new n ON o.path = n.path AND o.hash = n.hash""")
def delta_diff(spark: SparkSession, folder: str) -> DataFrame:
    return delta.diff(*versions(spark, folder), ["path", "hash"])


@query(f"WITH {VERSIONS} SELECT path, hash, 'c2' AS commit_sha FROM new")
def delta_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The index after the delta holds the new state, stamped with the new commit."""
    old, new = versions(spark, folder)
    return delta.apply_diff(old.withColumn("commit_sha", F.lit("c1")), new.withColumn("commit_sha", F.lit("c2")), ["path", "hash"], {"commit_sha": "c2"})


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_lww(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    merged = delta.upsert(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return merged.select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, c_name, c_custkey % 3 = 0 AS is_new FROM customer")
def upsert_is_new(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    return delta.with_is_new(customers.select("c_custkey", "c_name"), customers.filter("c_custkey % 3 <> 0"), ["c_custkey"])


@query("""
WITH cur AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY user_id), inc AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT * FROM cur UNION ALL SELECT * FROM inc ANTI JOIN cur USING (user_id)
""")
def insert_do_nothing(spark: SparkSession, folder: str) -> DataFrame:
    """Get or create: one row per key, the first that came."""
    events = table(spark, folder, "events")
    first = lambda r: events.filter(f"event_id % 2 = {r}").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return delta.insert_missing(first(0), first(1), ["user_id"])


@query("""
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'orders' AS relation, count(*) AS left_rows FROM orders ANTI JOIN gone USING (o_orderkey)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)
""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    gone = orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    kept = delta.delete(orders, gone, ["o_orderkey"])
    children = delta.delete(items, gone.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"])
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit(name).alias("relation"), "left_rows")
    return size(kept, "orders").unionByName(size(children, "lineitem"))


@query("""
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 AND o_orderstatus = 'F')
SELECT 'orders' AS relation, count(*) AS left_rows FROM orders ANTI JOIN gone USING (o_orderkey)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem ANTI JOIN gone ON l_orderkey = o_orderkey
""")
def owned_delete(spark: SparkSession, folder: str) -> DataFrame:
    """All finished orders are to go, asked for by the owner where its number is even and by another elsewhere: only the former go, with their items."""
    orders, items = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), table(spark, folder, "lineitem").select("l_orderkey")
    asked = orders.filter("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_custkey") + F.col("o_custkey") % 2 * 1_000_000_000).alias("o_custkey"))
    kept, gone = delta.delete_owned(orders, asked, "o_orderkey", "o_custkey")
    children = delta.delete(items, gone.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"])
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit(name).alias("relation"), "left_rows")
    return size(kept, "orders").unionByName(size(children, "lineitem"))


@query("SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def set_null_on_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of customers that are deleted (those in debt) stay, without their customer."""
    gone = table(spark, folder, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return delta.set_null(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("""
SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(parts AS INTEGER) AS parts, CAST((part - 1) * 15 + 1 AS INTEGER) AS first_line, CAST(least((part - 1) * 15 + 20, n) AS INTEGER) AS last_line,
  sha256(array_to_string(lines[(part - 1) * 15 + 1 : (part - 1) * 15 + 20], chr(10))) AS content_hash
FROM (SELECT doc_id, lines, len(lines) AS n, CASE WHEN len(lines) <= 20 THEN 1 ELSE ceil((len(lines) - 20) / 15.0)::BIGINT + 1 END AS parts FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
  unnest(range(1, parts + 1)) t(part)
""")
def line_window_split(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 20 lines that overlap by 5."""
    parts = line_windows(table(spark, folder, "documents").select("doc_id", "text"), "text", 20, 5)
    return parts.select("doc_id", "part", "parts", "first_line", "last_line", F.sha2("content", 256).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, folder: str) -> DataFrame:
    hashes = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashes.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


LEAVES = "leaves AS (SELECT source, sha256(text) AS hash FROM documents), parents AS (SELECT source, sha256(string_agg(hash, '|' ORDER BY hash)) AS hash FROM leaves GROUP BY source)"


def _leaves(spark: SparkSession, folder: str, text=None) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", F.sha2(F.col("text") if text is None else text, 256).alias("leaf"))


@query(f"WITH {LEAVES} SELECT source, hash FROM parents")
def merkle_components(spark: SparkSession, folder: str) -> DataFrame:
    return structure.parent_hashes(_leaves(spark, folder), "source", "leaf")


@query(f"WITH {LEAVES} SELECT 'repository' AS node, sha256(string_agg(hash, '|' ORDER BY hash)) AS hash FROM parents")
def merkle_root(spark: SparkSession, folder: str) -> DataFrame:
    parents = structure.parent_hashes(_leaves(spark, folder), "source", "leaf").withColumn("node", F.lit("repository"))
    return structure.parent_hashes(parents, "node", "hash", "root").select("node", F.col("root").alias("hash"))


@query("SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 0")
def merkle_changed_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Only parents of changed leaves get another hash."""
    changed = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    before = structure.parent_hashes(_leaves(spark, folder), "source", "leaf", "before")
    after = structure.parent_hashes(_leaves(spark, folder, changed), "source", "leaf", "after")
    return before.join(after, "source").filter("before <> after").select("source")


@query("""
SELECT 0 AS depth, count(*) AS nodes FROM region UNION ALL SELECT 1, count(*) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL SELECT 2, count(*) FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def summary_tree(spark: SparkSession, folder: str) -> DataFrame:
    """An adjacency list walked down from its roots, level by level."""
    nodes = (
        table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
        .unionByName(table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
        .unionByName(table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))
    )
    return spark.sql(
        """
        WITH RECURSIVE t(node, depth) AS (
          SELECT node, 0 FROM {nodes} WHERE parent IS NULL UNION ALL SELECT n.node, t.depth + 1 FROM {nodes} n JOIN t ON n.parent = t.node
        ) SELECT depth, count(*) AS nodes FROM t GROUP BY depth
        """,
        nodes=nodes,
    )


@query("""
SELECT event_type, count(*) AS rows_left, CAST(max(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS indexed FROM events WHERE NOT (event_type = 'view' AND event_id % 4 = 0) GROUP BY event_type
""")
def append_and_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Appended rows, a deleted set, and the state that follows."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    appended = events.filter("event_id % 5 <> 0").withColumn("state", F.lit(0)).unionByName(events.filter("event_id % 5 = 0").withColumn("state", F.lit(1)))
    left = delta.delete(appended, events.filter("event_type = 'view' and event_id % 4 = 0"), ["event_id"])
    return left.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows_left"), F.max("state").alias("indexed"))


@query("SELECT doc_id AS id, lang AS language, n_chars AS size FROM documents WHERE source = 'src3'")
def partition_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A pruned scan: the filter reaches the reader, and only four columns are read."""
    return table(spark, folder, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("n_chars").alias("size"))


@query("""
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(5 + len(string_split(text, chr(10))) - 1 AS INTEGER) AS end_line,
  CASE WHEN n_chars > 0 THEN round(len(string_split(text, ' ')) / n_chars::DOUBLE, 6) END AS ratio FROM documents
""")
def part_line_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Line arithmetic of a symbol that starts in line 5, without its header, and a ratio."""
    lines, words = F.size(F.split("text", "\n", -1)), F.size(F.split("text", " ", -1))
    ratio = F.when(F.col("n_chars") > 0, F.round(words / F.col("n_chars"), 6))
    return table(spark, folder, "documents").select("doc_id", lines.alias("lines"), (lines + 4).alias("end_line"), ratio.alias("ratio"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders)
SELECT o_custkey, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'O' THEN 'INDEXING' WHEN 'F' THEN 'INDEXED' ELSE 'FAILED' END AS status, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS indexed_commit FROM r GROUP BY o_custkey
""")
def index_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status transitions of a repository's index: a run goes on (O), succeeded (F) or failed (P); failures leave the pointer."""
    ok = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False)
    runs = table(spark, folder, "orders").select("o_custkey", "o_orderkey", ok.alias("ok"), F.col("o_orderkey").alias("commit"))
    return delta.transitions(runs, "o_custkey", "o_orderkey")


@query("""
WITH pending AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT o_orderkey, 'one_pending' AS violated FROM orders JOIN pending USING (o_custkey) WHERE o_orderstatus = 'P' AND o_orderkey > first
UNION ALL SELECT o_orderkey, 'dear_orders_are_closed' FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, 'customer_exists' FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT o_orderkey, 'status_known' FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL
""")
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    """A partial uniqueness, a check, a reference and a required column, over all orders."""
    orders = table(spark, folder, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("O")))
    rules = [
        Unique("one_pending", ("o_custkey",), ("o_orderkey",), "o_orderstatus = 'P'"), Check("dear_orders_are_closed", "o_totalprice <= 300000 or o_orderstatus = 'F'"),
        Reference("customer_exists", "o_custkey", table(spark, folder, "customer").filter("c_acctbal >= 0"), "c_custkey"), Required("status_known", "status"),
    ]
    return violations(orders, rules).select("o_orderkey", "violated")
