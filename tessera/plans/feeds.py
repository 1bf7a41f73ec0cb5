"""Feeds whose rows are applied in order (file changes, identities, frames of event streams, heads of repositories), sessions and what they talk about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import denied
from tessera.operators.delta import first_row
from tessera.operators.search import first_of_each
from tessera.operators.sessions import contexts, ended, found_or_made, issue_context, messages, repository_context, review_context
from tessera.plans.registry import query
from tessera.sources.landed import sync_plan as plan_of
from tessera.sources.tables import table
from tessera.streaming import frames, identity, pushes, sync

READ = 61


@query("""
WITH feed AS (
  SELECT event_id AS place, 'f' || user_id AS path, CASE event_type WHEN 'error' THEN 'removed' WHEN 'click' THEN 'renamed' ELSE 'modified' END AS status, 'f' || (user_id * 7 + event_id) % 200 AS previous_path FROM events
), told AS (
  SELECT path, place, status = 'removed' AS gone FROM feed UNION ALL SELECT previous_path, place, true FROM feed WHERE status = 'renamed' AND previous_path <> path
) SELECT path, arg_max(place, place * 2 + CASE WHEN gone THEN 0 ELSE 1 END) AS place, arg_max(gone, place * 2 + CASE WHEN gone THEN 0 ELSE 1 END) AS gone FROM told GROUP BY path
""")
def change_feed_states(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a feed of changes, removals and renames, all in one batch: what is left of each path."""
    n, kind = F.col("event_id"), F.col("event_type")
    feed = table(spark, folder, "events").select(
        n.alias("place"), F.concat(F.lit("f"), "user_id").alias("path"), F.when(kind == "error", "removed").when(kind == "click", "renamed").otherwise("modified").alias("status"),
        F.concat(F.lit("f"), (F.col("user_id") * 7 + n) % 200).alias("previous_path"), F.col("props").alias("content"), n.cast("string").alias("commit_sha"),
    )
    return sync.final_states(feed).select("path", F.col("place.place").alias("place"), "gone")


@query("""
WITH feed AS (SELECT user_id, event_id, event_type = 'error' AS deleted, event_type || event_id || '@example.com' AS email, nullif(trim('U' || (event_id % 3) || ' ' || CASE WHEN event_id % 2 = 0 THEN props ELSE '' END), '') AS name FROM events),
last AS (SELECT user_id, arg_max(event_id, event_id) AS sequence, arg_max(deleted, event_id) AS deleted, arg_max(email, event_id) AS email, arg_max(name, event_id) AS name FROM feed GROUP BY user_id)
SELECT 'u' || user_id AS external_id, sequence, email, name FROM last WHERE NOT deleted
""")
def identity_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Events as an identity feed, each with two addresses: errors delete, the rest upsert; keyed state keeps the last change of each user."""
    n, mail = F.col("event_id"), F.concat("event_type", "event_id", F.lit("@example.com"))
    address = lambda i, m: F.struct(F.lit(i).alias("id"), m.alias("email_address"))
    data = F.struct(
        F.concat(F.lit("u"), "user_id").alias("id"), F.concat(F.lit("U"), n % 3).alias("first_name"), F.when(n % 2 == 0, F.col("props")).otherwise("").alias("last_name"),
        F.array(address("a", F.lit("other@example.com")), address("b", mail)).alias("email_addresses"), F.lit("b").alias("primary_email_address_id"),
    )
    kind = F.when(F.col("event_type") == "error", "user.deleted").when(n % 5 == 0, "user.created").otherwise("user.updated")
    feed = table(spark, folder, "events").select(kind.alias("type"), data.alias("data"), n.alias("sequence"))
    none = spark.createDataFrame([], identity.USERS)
    return identity.applied(none, identity.last_changes(identity.identity_changes(feed)))


@query("""
WITH f AS (
  SELECT conv_id, -3 AS n, 'sessionId' AS kind, 's' || conv_id AS data FROM conversations GROUP BY conv_id
  UNION ALL SELECT conv_id, -2, 'sources', '[' || string_agg('{"turn":' || turn || '}', ',' ORDER BY turn) || ']' FROM conversations GROUP BY conv_id
  UNION ALL SELECT conv_id, -1, 'metadata', '{"turns":' || count(*) || '}' FROM conversations GROUP BY conv_id
  UNION ALL SELECT conv_id, turn, 'text', text FROM conversations
) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS position, kind, sha256(data) AS data_hash FROM f
""")
def frame_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of four kinds, sent as one body per conversation, cut into reads of 61 bytes wherever those end, and parsed with keyed state."""
    say = lambda kind, data: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data"))), F.lit("\n\n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    sent = table(spark, folder, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    texts = F.array_join(F.transform("t", lambda x: say("text", x["text"])), "")
    head = F.concat(say("sessionId", F.concat(F.lit("s"), "conv_id")), say("sources", F.transform("t", lambda x: F.struct(x["turn"].alias("turn")))), say("metadata", F.struct(F.size("t").alias("turns"))))
    body = sent.select(F.col("conv_id").cast("string").alias("session"), F.encode(F.concat(head, texts), "utf-8").alias("bytes"))
    n = F.ceil(F.octet_length("bytes") / READ).cast("long")
    cut = body.withColumn("n", n).withColumn("read", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    reads = cut.select("session", "read", F.substring(F.col("bytes"), (F.col("read") * READ + 1).cast("int"), F.lit(READ)).alias("body"), (F.col("read") + 1 == F.col("n")).alias("last"))
    return frames.frames(reads).select(F.col("session").cast("long").alias("conv_id"), "position", "kind", F.sha2("data", 256).alias("data_hash"))


@query("""
WITH repo AS (SELECT c_custkey AS repo_id, CASE WHEN c_acctbal < 0 THEN 'INDEXING' ELSE 'INDEXED' END AS status FROM customer),
head AS (SELECT o_custkey AS repo_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS head FROM orders GROUP BY 1),
done AS (SELECT o_custkey AS repo_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS indexed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT repo_id, head, indexed, CASE WHEN head IS NULL THEN 'missing' WHEN status = 'INDEXING' THEN 'already_indexing' WHEN indexed IS NULL THEN 'initial' WHEN indexed = head THEN 'up_to_date' ELSE 'delta' END AS action
FROM repo LEFT JOIN head USING (repo_id) LEFT JOIN done USING (repo_id)
""")
def sync_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as repositories, their orders as commits: the head commit, the last indexed one, and what a sync would do."""
    repositories = table(spark, folder, "customer").select(F.col("c_custkey").alias("repo_id"), F.when(F.col("c_acctbal") < 0, "INDEXING").otherwise("INDEXED").alias("status"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("sha"), F.struct("o_orderdate", "o_orderkey").alias("place"), "o_orderstatus")
    indexed = orders.filter("o_orderstatus = 'F'").groupBy("repo_id").agg(F.max_by("sha", "place").alias("indexed"))
    return plan_of(repositories.join(indexed, "repo_id", "left"), orders)


@query("""
WITH r AS (SELECT event_id, user_id, event_id % 40 AS finding, CASE event_type WHEN 'error' THEN 'ISSUE_CHAT' WHEN 'click' THEN 'QA' ELSE 'REVIEW' END AS kind, event_id % 3 = 0 AS old FROM events),
known AS (SELECT user_id, finding, min(event_id) AS known FROM r WHERE old AND kind = 'ISSUE_CHAT' GROUP BY ALL), first AS (SELECT user_id, finding, min(event_id) AS first FROM r WHERE NOT old AND kind = 'ISSUE_CHAT' GROUP BY ALL)
SELECT event_id, CASE WHEN kind = 'ISSUE_CHAT' THEN CAST(coalesce(known, first) AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS session_id, kind <> 'ISSUE_CHAT' OR (known IS NULL AND event_id = first) AS made
FROM r LEFT JOIN known USING (user_id, finding) LEFT JOIN first USING (user_id, finding) WHERE NOT old
""")
def sessions_found_or_made(spark: SparkSession, folder: str) -> DataFrame:
    """Events as requests for sessions, every third as a session that is there: one per finding and user for errors, a new one for the rest."""
    kind = F.when(F.col("event_type") == "error", "ISSUE_CHAT").when(F.col("event_type") == "click", "QA").otherwise("REVIEW")
    rows = table(spark, folder, "events").select("event_id", "user_id", (F.col("event_id") % 40).alias("finding_id"), kind.alias("kind"))
    sessions = rows.filter("event_id % 3 = 0").withColumnRenamed("event_id", "session_id")
    return found_or_made(sessions, rows.filter("event_id % 3 <> 0").withColumnRenamed("event_id", "request_id")).withColumnRenamed("request_id", "event_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey IS NOT NULL THEN 'completed' ELSE o_orderstatus END AS status FROM orders
""")
def sessions_ended_by_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is asked to end, one in three by its own customer."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"))
    asked = orders.select("session_id", (F.col("user_id") + F.when(F.col("session_id") % 3 == 0, 0).otherwise(1)).alias("user_id"))
    return ended(orders, asked).select(F.col("session_id").alias("o_orderkey"), "status")


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'Critical' WHEN 'A' THEN 'Major' ELSE 'minor' END AS severity, 'src/' || l_partkey % 50 || '.ts' AS path, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 4 END AS rank FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rank, path, l_linenumber) AS n FROM f),
review AS (SELECT l_orderkey, string_agg(upper(severity) || ' ' || path || ':' || l_linenumber || ' part ' || l_partkey, chr(10) ORDER BY n) FILTER (WHERE n <= 5) AS context, count(*) AS sources FROM n GROUP BY 1),
issue AS (SELECT l_orderkey, upper(severity) || ' ' || path || ':' || l_linenumber || ' part ' || l_partkey AS context FROM f WHERE l_linenumber = 1),
chunks AS (SELECT source, string_agg('[' || k || '] ' || doc_id, chr(10) ORDER BY k) AS context, count(*) AS sources FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 10 GROUP BY 1)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'REVIEW_CHAT' WHEN 1 THEN 'ISSUE_CHAT' ELSE 'REPO_QA' END AS kind,
  sha256(coalesce(CASE o_orderkey % 4 WHEN 0 THEN r.context WHEN 1 THEN i.context ELSE c.context END, '')) AS context_hash, CAST(coalesce(CASE o_orderkey % 4 WHEN 0 THEN r.sources WHEN 1 THEN CASE WHEN i.context IS NULL THEN 0 ELSE 1 END ELSE c.sources END, 0) AS BIGINT) AS sources
FROM orders LEFT JOIN review r ON r.l_orderkey = o_orderkey LEFT JOIN issue i ON i.l_orderkey = o_orderkey LEFT JOIN chunks c ON c.source = 'src' || o_custkey % 25
""")
def session_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sessions of four kinds, one of them unknown: a review's gravest findings first, a single finding, or the first chunks of a repository."""
    n = F.col("o_orderkey") % 4
    kind = F.when(n == 0, "REVIEW").when(n == 1, "ISSUE_CHAT").when(n == 2, "QA").otherwise("PAIRING")
    finding_id = F.concat("o_orderkey", F.lit("/1"))
    sessions = table(spark, folder, "orders").select(F.col("o_orderkey").alias("session_id"), kind.alias("kind"), F.col("o_orderkey").alias("review_id"), finding_id.alias("finding_id"), F.concat(F.lit("src"), F.col("o_custkey") % 25).alias("repository_id"))
    severity = F.when(F.col("l_returnflag") == "R", "Critical").when(F.col("l_returnflag") == "A", "Major").otherwise("minor")
    items = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"))
    findings = items.select(
        F.concat("l_orderkey", F.lit("/"), "l_linenumber").alias("finding_id"), F.col("l_orderkey").alias("review_id"), severity.alias("severity"), F.concat(F.lit("src/"), F.col("l_partkey") % 50, F.lit(".ts")).alias("path"),
        F.col("l_linenumber").alias("line"), F.concat(F.lit("part "), "l_partkey").alias("title"),
    )
    chunks = table(spark, folder, "documents").select(F.col("source").alias("repository_id"), F.col("doc_id").alias("position"), F.col("doc_id").cast("string").alias("path"))
    chunks = first_of_each(chunks, "repository_id", "position", 10)  # before they meet the sessions
    builders = {"REVIEW_CHAT": lambda s: review_context(s, findings.drop("finding_id"), 5), "ISSUE_CHAT": lambda s: issue_context(s, findings), "REPO_QA": lambda s: repository_context(s, chunks)}
    rows = contexts(sessions, builders)
    return rows.select(F.col("session_id").alias("o_orderkey"), "kind", F.sha2("context", 256).alias("context_hash"), F.col("sources").cast("long").alias("sources"))


@query("""
WITH m AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, sha256('system|about ' || conv_id || '|' || string_agg(role || '|' || text, '|' ORDER BY turn)) AS messages_hash, count(*) + 1 AS messages FROM m WHERE n <= 10 GROUP BY conv_id
""")
def prompt_messages(spark: SparkSession, folder: str) -> DataFrame:
    """A system message and the last ten turns, as one list."""
    rows = messages(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text", F.concat(F.lit("about "), "conv_id"))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "|")
    return rows.select("conv_id", F.sha2(flat, 256).alias("messages_hash"), F.size("messages").cast("long").alias("messages"))


@query(r"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'dist/' || page_id || '.js' ELSE 'src/' || page_id || '.ts' END AS path, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN html END AS patch FROM pages)
SELECT page_id, path, CAST(length(patch) AS BIGINT) AS size FROM p WHERE page_id % 4 <> 0 AND patch <> ''
""")
def reviewable_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are reviewed: not denied, and with a patch."""
    n = F.col("page_id")
    path = F.when(n % 4 == 0, F.concat(F.lit("dist/"), n, F.lit(".js"))).otherwise(F.concat(F.lit("src/"), n, F.lit(".ts")))
    patch = F.when(n % 3 == 0, "").when(n % 3 == 1, F.col("html"))
    rows = table(spark, folder, "pages").select("page_id", path.alias("path"), patch.alias("patch"))
    return rows.filter(~denied(F.col("path")) & (F.length("patch") > 0)).select("page_id", "path", F.length("patch").cast("long").alias("size"))


@query("""
SELECT event_id, event_type AS "activityType", '{"user":' || user_id || ',"value":' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ',"props":' || props || '}' AS metadata FROM events
""")
def activity_log(spark: SparkSession, folder: str) -> DataFrame:
    """Activity rows with their metadata as JSON, stored JSON nested in it as it is."""
    inner = F.from_json("props", "k int")
    metadata = F.to_json(F.struct(F.col("user_id").alias("user"), F.floor("value").alias("value"), inner.alias("props")))
    return table(spark, folder, "events").select("event_id", F.col("event_type").alias("activityType"), F.regexp_replace(metadata, '"k":(\\d+)', '"k": $1').alias("metadata"))


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1
""")
def first_writer(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each range, as the first capture of a range counts."""
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return first_row(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("""
WITH current AS (
  SELECT c_custkey AS repo_id, CASE c_custkey % 4 WHEN 0 THEN 'INDEXING' WHEN 1 THEN 'INDEXED' WHEN 2 THEN 'FAILED' ELSE 'NEW' END AS status,
    CASE WHEN c_custkey % 4 = 1 OR c_custkey % 8 = 0 THEN 'c' || c_custkey % 3 END AS indexed, CASE WHEN c_custkey % 4 < 2 THEN 'c' || c_custkey % 2 END AS head, CASE WHEN c_custkey % 4 = 0 THEN 'c' || c_custkey % 3 END AS running
  FROM customer
), feed AS (SELECT o_orderkey AS place, o_custkey AS repo_id, o_orderstatus AS kind, 'c' || o_orderkey % 3 AS sha FROM orders WHERE o_orderkey % 5 = 0),
heads AS (SELECT repo_id, arg_max(sha, place) AS pushed FROM feed WHERE kind = 'O' GROUP BY 1),
over AS (SELECT feed.repo_id, arg_max(place % 2 = 0, place) AS ok FROM feed JOIN current ON feed.repo_id = current.repo_id AND sha = running WHERE kind = 'F' GROUP BY 1),
a AS (
  SELECT repo_id, running, pushed, ok, CASE WHEN ok THEN running ELSE indexed END AS indexed, coalesce(pushed, head) AS head,
    CASE WHEN ok THEN 'INDEXED' WHEN NOT ok THEN 'FAILED' ELSE status END AS status, pushed IS NOT NULL OR (ok IS NOT NULL AND head IS DISTINCT FROM running) AS asked
  FROM current LEFT JOIN heads USING (repo_id) LEFT JOIN over USING (repo_id)
), b AS (SELECT *, status <> 'INDEXING' AND asked AND head IS NOT NULL AND head IS DISTINCT FROM indexed AS due FROM a)
SELECT repo_id, CASE WHEN due THEN 'INDEXING' ELSE status END AS status, indexed, head, CASE WHEN due THEN head WHEN status = 'INDEXING' THEN running END AS running,
  CASE WHEN due AND indexed IS NULL THEN 'initial' WHEN due THEN 'delta' WHEN pushed IS NOT NULL AND status = 'INDEXING' THEN 'already_indexing' WHEN pushed IS NOT NULL THEN 'up_to_date' WHEN ok IS NOT NULL THEN 'finished' END AS action
FROM b
""")
def push_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as repositories in all states, a fifth of the orders as one batch: open ones are pushes, closed ones outcomes of runs."""
    n = F.col("c_custkey")
    status = F.when(n % 4 == 0, "INDEXING").when(n % 4 == 1, "INDEXED").when(n % 4 == 2, "FAILED").otherwise("NEW")
    sha = lambda c, k: F.concat(F.lit("c"), c % k)
    current = table(spark, folder, "customer").select(
        n.alias("repo_id"), status.alias("status"), F.when((n % 4 == 1) | (n % 8 == 0), sha(n, 3)).alias("indexed"), F.when(n % 4 < 2, sha(n, 2)).alias("head"), F.when(n % 4 == 0, sha(n, 3)).alias("running"),
    )
    rows = table(spark, folder, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("repo_id"), sha(F.col("o_orderkey"), 3).alias("commit_sha"), F.col("o_orderkey").alias("place"), "o_orderstatus")
    pushed, over = rows.filter("o_orderstatus = 'O'").drop("o_orderstatus"), rows.filter("o_orderstatus = 'F'").withColumn("ok", F.col("place") % 2 == 0)
    return pushes.moved(current, current.select("repo_id"), pushed, over)
