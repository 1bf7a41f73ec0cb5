"""Chat sessions: found or made, ended by their owners, and the context that each kind of session talks about."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import severity_rank

# Kinds of sessions, other names of them, the kind that has one session per finding and user, and the kind that stands in for unknown ones.
ALIASES = {"QA": "REPO_QA", "REVIEW": "REVIEW_CHAT"}
KEYED, DEFAULT = "ISSUE_CHAT", "REPO_QA"


def kind_of(name: Column) -> Column:
    out = name
    for alias, kind in ALIASES.items():
        out = F.when(name == alias, kind).otherwise(out)
    return out


def found_or_made(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, session_id, made): for each request (request_id, kind, user_id, finding_id) the session it talks in.

    Requests of the keyed kind with a finding share one session per (finding, user): the oldest that `sessions` (session_id, kind, user_id, finding_id) has, else one that the first such
    request makes. All others make their own. A made session has its request's id, as text.
    """
    asked = requests.withColumn("kind", kind_of(F.col("kind")))
    keyed = (F.col("kind") == KEYED) & F.col("finding_id").isNotNull() & F.col("user_id").isNotNull()
    own = asked.filter(~F.coalesce(keyed, F.lit(False))).select("request_id", F.col("request_id").cast("string").alias("session_id"), F.lit(True).alias("made"))
    key = ["finding_id", "user_id"]
    known = sessions.filter(kind_of(F.col("kind")) == KEYED).groupBy(*key).agg(F.min("session_id").alias("known"))
    shared = asked.filter(keyed)
    first = shared.groupBy(*key).agg(F.min("request_id").alias("first"))
    shared = shared.join(first, key).join(known, key, "left")
    session = F.coalesce(F.col("known").cast("string"), F.col("first").cast("string"))
    return own.unionByName(shared.select("request_id", session.alias("session_id"), (F.col("known").isNull() & (F.col("request_id") == F.col("first"))).alias("made")))


def ended(sessions: DataFrame, requests: DataFrame, status: str = "completed") -> DataFrame:
    """`sessions` (session_id, user_id, status) with the status of those that their own user asked to end; requests (session_id, user_id) of others change nothing."""
    asked = requests.select("session_id", "user_id").filter("user_id is not null").distinct().withColumn("_asked", F.lit(True))
    return sessions.join(asked, ["session_id", "user_id"], "left").withColumn("status", F.when(F.col("_asked"), status).otherwise(F.col("status"))).select(*sessions.columns)


def messages(turns: DataFrame, session: str, order: str, role: str, text: str, system: Column, last: int = 10) -> DataFrame:
    """(session, messages): a system message, then the last turns in their order, each (role, content); roles but assistant are the user's."""
    said = F.struct(F.col(order), F.when(F.col(role) == "assistant", "assistant").otherwise("user").alias("role"), F.col(text).alias("content"))
    rows = turns.groupBy(session).agg(F.sort_array(F.collect_list(said)).alias("x"))
    kept = F.slice("x", F.greatest(F.size("x") - last + 1, F.lit(1)), F.lit(last))
    history = F.transform(kept, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.select(session, F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), history).alias("messages"))


def review_context(sessions: DataFrame, findings: DataFrame, most: int | None = None) -> DataFrame:
    """(session_id, context, sources): a review's findings (review_id, severity, path, line, title), the gravest first, then by path and line; `most` of them at most."""
    line = F.concat_ws(" ", F.upper(F.coalesce("severity", F.lit("info"))), F.concat_ws(":", "path", F.col("line").cast("string")), "title")
    lines = F.sort_array(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "path", "line", "title", line.alias("shown"))))
    rows = sessions.join(findings, "review_id", "left").groupBy("session_id").agg(F.filter(lines, lambda x: x["path"].isNotNull()).alias("x"))
    kept = F.col("x") if most is None else F.slice("x", 1, most)
    return rows.select("session_id", F.array_join(F.transform(kept, lambda x: x["shown"]), "\n").alias("context"), F.size("x").alias("sources"))


def issue_context(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """(session_id, context, sources): the one finding (finding_id, severity, path, line, title) a session is about."""
    rows = sessions.join(findings.select("finding_id", "severity", "path", "line", "title"), "finding_id", "left")
    shown = F.concat_ws(" ", F.upper("severity"), F.concat_ws(":", "path", F.coalesce(F.col("line").cast("string"), F.lit("N/A"))), "title")
    return rows.select("session_id", F.when(F.col("path").isNotNull(), shown).otherwise("").alias("context"), F.col("path").isNotNull().cast("int").alias("sources"))


def repository_context(sessions: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """(session_id, context, sources): the first chunks (repository_id, position, path) of a session's repository, numbered."""
    kept = F.slice(F.sort_array(F.collect_list(F.struct("position", "path"))), 1, most)
    rows = sessions.join(chunks, "repository_id", "left").groupBy("session_id").agg(F.filter(kept, lambda x: x["path"].isNotNull()).alias("x"))
    return rows.select("session_id", F.array_join(F.transform("x", lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x["path"])), "\n").alias("context"), F.size("x").alias("sources"))


def contexts(sessions: DataFrame, builders: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(session_id, kind, context, sources) of all sessions, each by its kind's builder; kinds without one, null among them, by the default's."""
    kind = kind_of(F.col("kind"))
    named = sessions.withColumn("kind", F.when(kind.isin(*builders), kind).otherwise(DEFAULT))
    out = None
    for name, build in builders.items():
        rows = build(named.filter(F.col("kind") == name)).select("session_id", F.lit(name).alias("kind"), "context", "sources")
        out = rows if out is None else out.unionByName(rows)
    return out
