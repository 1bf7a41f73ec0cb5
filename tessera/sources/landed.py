"""Readers of landed JSON from code hosts and identity webhooks, under declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPOSITORY = (
    "id bigint, name string, owner struct<login: string>, description string, language string, private boolean, default_branch string, html_url string, clone_url string, pushed_at timestamp"
)
PULL = "number int, title string, body string, state string, draft boolean, html_url string, user struct<login: string>, head struct<sha: string>, updated_at timestamp"
FILE = "filename string, status string, additions int, deletions int, patch string, previous_filename string"
PULL_DETAIL = f"{PULL}, files array<struct<{', '.join(c.replace(' ', ': ', 1) for c in FILE.split(', '))}>>"
IDENTITY = "type string, data struct<id: string, first_name: string, last_name: string, email_addresses: array<struct<id: string, email_address: string>>, primary_email_address_id: string>"
CHANGE = "path string, content string, status string, previous_path string, commit_sha string"
PUSH = "ref string, after string, repository struct<id: bigint, default_branch: string>"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def repositories(rows: DataFrame) -> DataFrame:
    """Eleven flat columns of a repository listing."""
    return rows.select(
        F.col("id").alias("github_repo_id"), F.col("owner.login").alias("owner"), "name", "description", "language", F.col("private").alias("is_private"),
        "default_branch", "html_url", "clone_url", F.col("pushed_at").alias("last_pushed_at"), F.lit(None).cast("timestamp").alias("last_synced_at"),
    )


def pulls(rows: DataFrame) -> DataFrame:
    """Pull requests, the newest first; a draft has its own status."""
    status = F.when(F.col("draft"), "draft").otherwise(F.col("state"))
    return rows.select("number", "title", F.col("user.login").alias("author"), F.col("head.sha").alias("head_sha"), status.alias("status"), "updated_at").orderBy(F.desc("updated_at"), F.desc("number"))


def pull_files(rows: DataFrame) -> DataFrame:
    """One row per changed file; a missing patch is ''."""
    return rows.select("number", F.inline("files")).withColumn("patch", F.coalesce("patch", F.lit("")))


def tree(rows: DataFrame) -> DataFrame:
    """Blobs of a full tree (path, type, content) as additions: no lock files, no build output, no empty contents."""
    kept = (F.col("type") == "blob") & ~F.col("path").contains("package-lock.json") & ~F.col("path").startswith("dist/") & (F.length("content") > 0)
    return rows.filter(kept).select("path", "content", F.lit("added").alias("status"))


def default_branch_pushes(rows: DataFrame, *kept: str) -> DataFrame:
    """(github_repo_id, commit_sha, and the columns `kept`) of the pushes (PUSH schema) to the default branch; pushes without a branch or a repository go."""
    on_default = F.col("ref") == F.concat(F.lit("refs/heads/"), F.col("repository.default_branch"))
    return rows.filter(on_default).select(F.col("repository.id").alias("github_repo_id"), F.col("after").alias("commit_sha"), *kept)


def sync_plan(repositories: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, head, indexed, action): one row per repository with its head commit, the last of `commits` (repo_id, sha, place).

    action: missing (no commit), already_indexing (a run is on), initial (nothing was indexed), up_to_date, or delta. repositories: (repo_id, status, indexed).
    """
    heads = commits.groupBy("repo_id").agg(F.max_by("sha", "place").alias("head"))
    action = (
        F.when(F.col("head").isNull(), "missing").when(F.col("status") == "INDEXING", "already_indexing").when(F.col("indexed").isNull(), "initial")
        .when(F.col("indexed") == F.col("head"), "up_to_date").otherwise("delta")
    )
    return repositories.join(heads, "repo_id", "left").select("repo_id", "head", "indexed", action.alias("action"))


def users(events: DataFrame, sequence: str) -> DataFrame:
    """(external_id, sequence, deleted, email, name) of an identity feed: the primary address if there is one, else the first; '' where there is none."""
    mails = F.col("data.email_addresses")
    primary = F.filter(mails, lambda m: m["id"] == F.col("data.primary_email_address_id"))
    mail = F.coalesce(F.get(primary, F.lit(0))["email_address"], F.get(mails, F.lit(0))["email_address"], F.lit(""))
    name = F.nullif(F.concat_ws(" ", F.nullif(F.col("data.first_name"), F.lit("")), F.nullif(F.col("data.last_name"), F.lit(""))), F.lit(""))
    deleted = F.col("type") == "user.deleted"
    kept = events.filter(F.col("type").isin("user.created", "user.updated", "user.deleted"))
    return kept.select(F.col("data.id").alias("external_id"), F.col(sequence).alias("sequence"), deleted.alias("deleted"), F.when(~deleted, mail).alias("email"), F.when(~deleted, name).alias("name"))
