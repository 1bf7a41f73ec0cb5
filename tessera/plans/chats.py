"""Conversation, interview and activity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.schemas import missing, parsed, within
from tessera.functions.text import age, interview_ready, with_feedback
from tessera.plans.registry import query
from tessera.sources import landed
from tessera.sources.tables import table


def by_turn(*columns: str) -> Window:
    return Window.partitionBy("conv_id").orderBy(*(columns or ("turn",)))


@query("""
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3
""")
def last_n_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The last three turns of each conversation, in order."""
    last = table(spark, folder, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("n <= 3")
    role = F.when(F.col("role") == "assistant", "model").otherwise("user")
    return last.withColumn("position", F.row_number().over(by_turn())).select("conv_id", "turn", role.alias("role"), "position")


@query("SELECT conv_id, turn, role FROM conversations")
def dedupe_user_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn is sent twice; the echo goes."""
    turns = table(spark, folder, "conversations").withColumn("again", F.lit(0))
    doubled = turns.unionByName(turns.filter("role = 'user'").withColumn("again", F.lit(1)))
    window = by_turn("turn", "again")
    echo = (F.col("role") == "user") & (F.lag("role").over(window) == "user") & (F.lag("text").over(window) == F.col("text"))
    return doubled.withColumn("echo", F.coalesce(echo, F.lit(False))).filter("not echo").select("conv_id", "turn", "role")


@query("""
SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'REPO_QA' WHEN 1 THEN 'REVIEW_CHAT' ELSE 'INTERVIEW' END AS type, CASE conv_id % 3 WHEN 0 THEN 'Repository chat' WHEN 1 THEN 'Review chat' ELSE 'Chat' END AS title, max(turn) AS last_turn
FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id
""")
def session_list(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions under a conjunction of optional filters, old type names mapped, titles by type."""
    raw = F.when(F.col("conv_id") % 3 == 0, "QA").when(F.col("conv_id") % 3 == 1, "REVIEW").otherwise("INTERVIEW")
    kind = F.when(F.col("type") == "QA", "REPO_QA").when(F.col("type") == "REVIEW", "REVIEW_CHAT").otherwise(F.col("type"))
    wanted = {"owner": 0, "repository": None}
    rows = table(spark, folder, "conversations").withColumns({"type": raw, "owner": F.col("conv_id") % 2, "repository": F.lit("r")}).withColumn("type", kind)
    for column, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    title = F.coalesce(F.lit(None).cast("string"), F.when(F.col("type") == "REPO_QA", "Repository chat").when(F.col("type") == "REVIEW_CHAT", "Review chat").otherwise("Chat"))
    return rows.groupBy("conv_id", "type").agg(F.max("turn").alias("last_turn")).select("conv_id", "type", title.alias("title"), "last_turn")


@query("""
SELECT conv_id, sha256(string_agg('[' || n || '] ' || upper(role) || ': ' || text, chr(10) ORDER BY turn)) AS transcript_hash, count(*) AS sources
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id
""")
def transcript_agg(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered turns as one ordered text."""
    line = F.concat(F.lit("["), F.row_number().over(by_turn()).cast("string"), F.lit("] "), F.upper("role"), F.lit(": "), "text")
    rows = table(spark, folder, "conversations").withColumn("line", line)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg(F.sha2(text, 256).alias("transcript_hash"), F.count(F.lit(1)).alias("sources"))


@query("""
SELECT conv_id, string_agg(role, ',' ORDER BY f) AS topics, CAST(sum(n) FILTER (WHERE role = 'assistant') AS BIGINT) AS questions
FROM (SELECT conv_id, role, min(turn) AS f, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id
""")
def interview_state(spark: SparkSession, folder: str) -> DataFrame:
    """State merged over turns: topics in the order of their first appearance, questions counted, written and read as JSON."""
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count_if(F.col("role") == "assistant").alias("q"))
    topics = F.array_distinct(F.transform("t", lambda x: x["role"]))
    state = F.struct(F.lit("start").alias("status"), topics.alias("topics"), F.when(F.col("q") > 0, F.col("q")).alias("questions"))
    back = F.from_json(F.to_json(state.withField("status", F.lit("completed"))), "status string, topics array<string>, questions long")
    return turns.withColumn("s", back).select("conv_id", F.array_join("s.topics", ",").alias("topics"), F.col("s.questions").alias("questions"))


@query("""
SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'system') > 0 THEN 'system' ELSE 'None yet' END AS covered, CASE WHEN max(turn) >= 4 THEN 'completed' ELSE 'active' END AS status FROM conversations GROUP BY conv_id
""")
def interview_progress(spark: SparkSession, folder: str) -> DataFrame:
    """A completed status by condition; an empty list of topics reads 'None yet'."""
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "system", F.col("role"))).alias("topics"), F.max("turn").alias("last"))
    covered = F.when(F.size("topics") > 0, F.array_join("topics", ", ")).otherwise("None yet")
    return rows.select("conv_id", covered.alias("covered"), F.when(F.col("last") >= 4, "completed").otherwise("active").alias("status"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS so_far FROM conversations")
def dialogue_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", F.row_number().over(by_turn()).alias("position"), F.sum(F.length("text")).over(by_turn()).alias("so_far"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, role FROM conversations WHERE role <> 'system'")
def findings_explode(spark: SparkSession, folder: str) -> DataFrame:
    """Nested findings written as JSON, read under a schema and made rows again."""
    packed = table(spark, folder, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role"))).alias("payload"))
    rows = packed.select("conv_id", F.inline(F.from_json("payload", "array<struct<turn: bigint, role: string>>", {"mode": "FAILFAST"})))
    return rows.filter("role <> 'system'")


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS text_hash, count(*) AS frames FROM conversations GROUP BY conv_id")
def frame_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Text frames of a stream, cut at blank lines, put together again in their order; none is lost."""
    frame = F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("text").alias("type"), "turn", F.col("text").alias("data"))))
    sent = table(spark, folder, "conversations").withColumn("frame", frame).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "frame"))), lambda x: x["frame"]), "\n\n").alias("body"))
    frames = sent.select("conv_id", F.posexplode(F.split("body", "\n\n", -1)).alias("pos", "frame"))
    read = frames.withColumn("x", F.from_json(F.regexp_replace("frame", "^data: ", ""), "type string, turn long, data string")).filter("x.type = 'text'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x.data"))), lambda x: x["data"]), "")
    return read.groupBy("conv_id").agg(F.sha2(text, 256).alias("text_hash"), F.count(F.lit(1)).alias("frames"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 5")
def activity_feed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").orderBy(F.desc("ts"), "event_id").limit(5).select("event_id", "user_id", "event_type")


@query("SELECT event_id AS id, event_type AS \"activityType\" FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 2")
def recent_work(spark: SparkSession, folder: str) -> DataFrame:
    mine = table(spark, folder, "events").filter("user_id = 7").orderBy(F.desc("ts"), "event_id").limit(2)
    return mine.select(F.col("event_id").alias("id"), F.col("event_type").alias("activityType"))


@query("""
SELECT event_id, CASE WHEN s < 60 THEN s || ' seconds ago' WHEN s < 3600 THEN s // 60 || ' minutes ago' WHEN s < 86400 THEN s // 3600 || ' hours ago' WHEN s < 172800 THEN 'Yesterday' ELSE s // 86400 || ' days ago' END AS ago
FROM (SELECT event_id, epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)
""")
def time_ago(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", age(F.col("ts"), F.lit("2024-02-01 00:00:00")).alias("ago"))


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS indexed, count(*) FILTER (WHERE event_type IN ('click', 'signup')) AS indexing, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY user_id
""")
def status_counters(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    counted = {"indexed": kind == "view", "indexing": kind.isin("click", "signup"), "failed": kind == "error"}
    return table(spark, folder, "events").groupBy("user_id").agg(*[F.count_if(c).alias(n) for n, c in counted.items()], F.count(F.lit(1)).alias("total"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("""
SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN CAST(CASE WHEN event_id % 6 = 2 THEN NULL ELSE event_id % 100 END AS INTEGER) END AS score, CASE event_id % 6 WHEN 0 THEN user_id || ' notes' WHEN 1 THEN '' END AS notes,
  CASE event_id % 6 WHEN 3 THEN 'broken' WHEN 4 THEN 'absent' WHEN 5 THEN 'absent' ELSE 'read' END AS state FROM events
""")
def nested_state(spark: SparkSession, folder: str) -> DataFrame:
    """State as it may be stored: nested, with an object kept as text, with a wrong type, broken off, without the field, and no object at all."""
    n, score, who = F.col("event_id") % 6, (F.col("event_id") % 100).cast("string"), F.col("user_id").cast("string")
    nested = F.concat(F.lit('{"evaluation": {"score": '), score, F.lit(', "notes": [{"text": "'), who, F.lit(' notes"}]}}'))
    as_text = F.concat(F.lit('{"evaluation": "{\\"score\\": '), score, F.lit(', \\"notes\\": [{\\"text\\": \\"\\"}]}"}'))
    state = F.when(n == 0, nested).when(n == 1, as_text).when(n == 2, '{"evaluation": {"score": "none", "notes": []}}').when(n == 3, '{"evaluation": {').when(n == 4, F.col("props")).otherwise("[1]")
    inner = within(state, "evaluation")
    found = F.when(F.try_parse_json(state).isNull(), "broken").when(inner.isNull(), "absent").otherwise("read")
    return table(spark, folder, "events").select("event_id", F.try_variant_get(inner, "$.score", "int").alias("score"), F.try_variant_get(inner, "$.notes[0].text", "string").alias("notes"), found.alias("state"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'findings' WHEN 2 THEN 'overall_score,risk_level' ELSE 'summary,overall_score,risk_level,findings' END AS missing,
  CASE WHEN event_id % 4 < 2 THEN CAST(event_id % 100 AS INTEGER) END AS score FROM events
""")
def schema_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Model output under its declared schema: the required fields that a payload lacks, null ones too, all if it is no JSON."""
    n, score = F.col("event_id") % 4, (F.col("event_id") % 100).cast("string")
    whole = F.concat(F.lit('{"summary": "s", "findings": [], "risk_level": "Low", "overall_score": '), score, F.lit("}"))
    partly = F.concat(F.lit('{"summary": "s", "risk_level": "Low", "overall_score": '), score, F.lit("}"))
    payload = F.when(n == 0, whole).when(n == 1, partly).when(n == 2, '{"summary": "s", "findings": [{"title": "t"}], "overall_score": null}').otherwise("no json")
    return table(spark, folder, "events").select("event_id", F.array_join(missing(payload, "review"), ",").alias("missing"), parsed(payload, "review")["overall_score"].alias("score"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '**Corrective Feedback:**' || chr(10) || 'because ' || turn || chr(10) || chr(10) || '**Key Points:**' || chr(10) || '- ' || role || chr(10) || '- b' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'next' ELSE 'next' END AS shown FROM conversations
""")
def corrective_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """An evaluated turn's next question, after its corrective feedback where some is needed."""
    needed = F.when(F.col("turn") % 3 == 0, "true").otherwise("false")
    payload = F.concat(F.lit('{"nextQuestion": "next", "correction": {"needed": '), needed, F.lit(', "explanation": "because '), F.col("turn").cast("string"), F.lit('", "keyPoints": ["'), F.col("role"), F.lit('", "b"]}}'))
    got = parsed(payload, "turn_evaluation")
    return table(spark, folder, "conversations").select("conv_id", "turn", with_feedback(got["nextQuestion"], got["correction"]).alias("shown"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS shown, TIMESTAMP '2024-02-01' AS touched FROM orders")
def date_display(spark: SparkSession, folder: str) -> DataFrame:
    """Dates are shown in one format; touches take a stated time, so results repeat."""
    return table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("shown"), F.expr("timestamp_ntz '2024-02-01 00:00:00'").alias("touched"))


@query("SELECT event_id, event_type <> 'error' AND event_id % 3 = 0 AS ready FROM events")
def interview_config(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations are valid if mode and difficulty are there: neither missing, null nor empty."""
    mode = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    difficulty = F.when(F.col("event_id") % 3 == 0, ', "difficulty": "hard"}').when(F.col("event_id") % 3 == 1, ', "difficulty": null}').otherwise("}")
    config = F.from_json(F.concat(F.lit('{"mode": "'), mode, F.lit('"'), difficulty), "mode string, difficulty string")
    return table(spark, folder, "events").select("event_id", interview_ready(config).alias("ready"))


@query("SELECT event_id AS github_repo_id, 'c' || event_id AS commit_sha FROM events WHERE event_type = 'view' AND event_id % 3 = 0 OR event_type = 'click' AND event_id % 3 = 1")
def push_default_branch(spark: SparkSession, folder: str) -> DataFrame:
    """Of pushes to branches and tags those to each repository's default branch."""
    ref = F.when(F.col("event_id") % 3 == 0, "refs/heads/view").when(F.col("event_id") % 3 == 1, "refs/heads/click").otherwise("refs/tags/view")
    repository = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("default_branch"))
    pushed = F.struct(ref.alias("ref"), F.concat(F.lit("c"), "event_id").alias("after"), repository.alias("repository"))
    rows = table(spark, folder, "events").select(F.from_json(F.to_json(pushed), landed.PUSH).alias("push")).select("push.*")
    return landed.default_branch_pushes(rows)
