"""Review queries: orders stand in for reviews, line items for findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.schemas import missing, parsed
from tessera.functions.text import severity_bucket, severity_rank
from tessera.operators import delta
from tessera.plans.registry import query
from tessera.sources.tables import table

RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders)"
SEVERITY = "CASE l_returnflag WHEN 'R' THEN 'Critical' WHEN 'A' THEN 'Major' ELSE 'minor' END"


def ranked_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews of a pull request: the flagged one first, else the newest."""
    order = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "P").desc(), F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, folder, "orders").withColumn("n", F.row_number().over(order))


def findings(spark: SparkSession, folder: str) -> DataFrame:
    severity = F.when(F.col("l_returnflag") == "R", "Critical").when(F.col("l_returnflag") == "A", "Major").otherwise("minor")
    return table(spark, folder, "lineitem").withColumn("severity", severity)


@query(f"WITH {RANKED} SELECT o_custkey, o_orderkey, o_orderstatus FROM ranked WHERE n = 1")
def latest_review(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_reviews(spark, folder).filter("n = 1").select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"WITH {RANKED} SELECT o_custkey, o_orderkey, CAST(n - 1 AS INTEGER) AS position FROM ranked WHERE n > 1")
def review_history(spark: SparkSession, folder: str) -> DataFrame:
    """All but the latest, newest first."""
    return ranked_reviews(spark, folder).filter("n > 1").select("o_custkey", "o_orderkey", (F.col("n") - 1).alias("position"))


@query(f"""WITH {RANKED}
SELECT r.o_custkey, r.o_orderkey, count(l.l_orderkey) AS findings, coalesce(string_agg(l.l_suppkey || ':' || coalesce(nullif(l.l_linenumber, 1)::VARCHAR, '-'), ',' ORDER BY l.l_suppkey, nullif(l.l_linenumber, 1) NULLS LAST), '') AS listed
FROM ranked r LEFT JOIN lineitem l ON l.l_orderkey = r.o_orderkey WHERE r.n = 1 GROUP BY 1, 2""")
def review_with_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The latest review with its findings nested, ordered by file and line, nulls last; line 1 stands for a finding without a line."""
    latest = ranked_reviews(spark, folder).filter("n = 1").select("o_custkey", "o_orderkey")
    nested = latest.join(findings(spark, folder), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_custkey", "o_orderkey")
    line = F.nullif("l_linenumber", F.lit(1))
    items = F.array_sort(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), F.struct("l_suppkey", line.isNull().alias("last"), line.alias("line")))))
    return nested.agg(items.alias("items")).select(
        "o_custkey", "o_orderkey", F.size("items").cast("long").alias("findings"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_suppkey"], F.coalesce(x["line"].cast("string"), F.lit("-")))), ",").alias("listed")
    )


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, o.o_custkey, c.c_name AS repository FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
""")
def finding_context(spark: SparkSession, folder: str) -> DataFrame:
    """A finding with its review and its repository."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("repository"))
    return items.join(orders, "l_orderkey").join(customers, "o_custkey").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "o_custkey", "repository")


@query(f"""SELECT {SEVERITY} AS severity, CAST(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 4 END AS INTEGER) AS rank, lower({SEVERITY}) AS shown, count(*) AS findings FROM lineitem GROUP BY ALL""")
def severity_rank_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks are case sensitive: 'minor' ranks last."""
    items = findings(spark, folder).withColumn("rank", severity_rank(F.col("severity"))).withColumn("shown", F.lower("severity"))
    return items.groupBy("severity", "rank", "shown").agg(F.count(F.lit(1)).alias("findings"))


@query(f"WITH {RANKED} SELECT c_custkey, (o_orderkey IS NULL OR o_orderkey % 10 <> c_custkey % 10) AS stale FROM customer LEFT JOIN (SELECT * FROM ranked WHERE n = 1) ON o_custkey = c_custkey")
def stale_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """A pull request whose head differs from what its latest review saw."""
    latest = ranked_reviews(spark, folder).filter("n = 1").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    stale = F.col("o_orderkey").isNull() | (F.col("o_orderkey") % 10 != F.col("c_custkey") % 10)
    return table(spark, folder, "customer").join(latest, "c_custkey", "left").select("c_custkey", stale.alias("stale"))


@query("SELECT c_mktsegment AS repository, count(*) AS reviews, max(o_orderkey) AS last_review FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def review_overview(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("repository")).agg(F.count(F.lit(1)).alias("reviews"), F.max("o_orderkey").alias("last_review"))


@query("""
SELECT o_orderkey, CASE WHEN s = 100 THEN 'perfect' WHEN s >= 90 THEN 'excellent' WHEN s >= 80 THEN 'good' WHEN s >= 70 THEN 'fair' ELSE 'poor' END AS band, CASE WHEN o_orderstatus = 'O' THEN 'draft' ELSE 'open' END AS state
FROM (SELECT o_orderkey, o_orderstatus, o_orderkey % 101 AS s FROM orders)
""")
def score_bands(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("o_orderkey") % 101
    band = F.when(s == 100, "perfect").when(s >= 90, "excellent").when(s >= 80, "good").when(s >= 70, "fair").otherwise("poor")
    return table(spark, folder, "orders").select("o_orderkey", band.alias("band"), F.when(F.col("o_orderstatus") == "O", "draft").otherwise("open").alias("state"))


@query("""
SELECT o_orderkey, 'user' || o_custkey AS author, count(l_orderkey) AS files, coalesce(min(l_suppkey), -1) AS first_file FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey
""")
def nested_pr_files(spark: SparkSession, folder: str) -> DataFrame:
    """A pull request with its files nested, nested fields pulled up, a missing patch as ''."""
    files = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_suppkey")).alias("files"))
    pulls = table(spark, folder, "orders").select("o_orderkey", F.struct(F.concat(F.lit("user"), "o_custkey").alias("login")).alias("owner")).join(files, "o_orderkey", "left")
    return pulls.select(
        "o_orderkey", F.col("owner.login").alias("author"), F.coalesce(F.size("files"), F.lit(0)).cast("long").alias("files"), F.coalesce(F.get("files", F.lit(0)), F.lit(-1).cast("long")).alias("first_file")
    ).withColumn("files", F.greatest("files", F.lit(0).cast("long")))


@query("""
WITH n AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT o.o_custkey, o.o_orderkey, o.o_orderkey = n.k AS is_latest FROM orders o JOIN n USING (o_custkey)
""")
def review_commit(spark: SparkSession, folder: str) -> DataFrame:
    """Old reviews are demoted and the new one inserted in one rewrite: is_latest is derived, never mutated."""
    reviews = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    merged = delta.insert_missing(reviews.filter("o_orderkey % 2 = 0"), reviews.filter("o_orderkey % 2 = 1"), ["o_orderkey"])
    return merged.withColumn("is_latest", F.col("o_orderkey") == F.max("o_orderkey").over(Window.partitionBy("o_custkey")))


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 100 AS score, CASE o_orderkey % 3 WHEN 0 THEN 'warning' WHEN 1 THEN 'Critical' ELSE 'Praise' END AS severity FROM orders WHERE o_orderkey % 5 <> 4)
SELECT o_orderkey, 'review' AS kind, CAST(score AS VARCHAR) AS value FROM r
UNION ALL SELECT o_orderkey, 'finding', 'f' || o_orderkey || ' ' || CASE severity WHEN 'warning' THEN 'major' WHEN 'Critical' THEN 'critical' ELSE 'info' END FROM r
UNION ALL SELECT o_orderkey, 'user', 'look at ' || o_orderkey FROM r
UNION ALL SELECT o_orderkey, 'ai', '{"summary":"s","overall_score":' || score || ',"risk_level":"Low","findings":[{"severity":"' || severity || '","file_path":"f' || o_orderkey || '"}]}' FROM r
""")
def review_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A model's review becomes a review row, its findings and two audit rows, together or not at all: payloads that lack a required field commit nothing."""
    n = F.col("o_orderkey") % 3
    severity = F.when(n == 0, "warning").when(n == 1, "Critical").otherwise("Praise")
    whole = F.to_json(F.struct(F.lit("s").alias("summary"), (F.col("o_orderkey") % 100).alias("overall_score"), F.lit("Low").alias("risk_level"), F.array(F.struct(severity.alias("severity"), F.concat(F.lit("f"), "o_orderkey").alias("file_path"))).alias("findings")))
    payload = F.when(F.col("o_orderkey") % 5 != 4, whole).otherwise('{"summary": "s"}')
    asked = table(spark, folder, "orders").select("o_orderkey", payload.alias("payload"), F.concat(F.lit("look at "), "o_orderkey").alias("prompt"))
    return committed(asked)


def committed(reviews: DataFrame) -> DataFrame:
    """(o_orderkey, kind, value) rows of whole reviews (o_orderkey, prompt, payload)."""
    whole = reviews.filter(F.size(missing(F.col("payload"), "review")) == 0).withColumn("got", parsed(F.col("payload"), "review"))
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    found = F.transform("got.findings", lambda f: row("finding", F.concat_ws(" ", f["file_path"], severity_bucket(f["severity"]))))
    rows = F.concat(F.array(row("review", F.col("got.overall_score").cast("string")), row("user", F.col("prompt")), row("ai", F.col("payload"))), F.coalesce(found, F.array().cast("array<struct<kind: string, value: string>>")))
    return whole.select("o_orderkey", F.inline(rows))
