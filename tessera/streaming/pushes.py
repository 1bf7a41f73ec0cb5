"""Pushes to default branches start index runs: a control table with one row per repository, moved on by a feed of registrations, pushes and outcomes.

A repository has one run at a time. A push that arrives during a run is kept as the new head, and the outcome of that run starts the next one, so no push is lost
and none is indexed twice. A failed run leaves the pointer where it was and waits for a push. Outcomes of other runs than the present one say nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.landed import PUSH, default_branch_pushes
from tessera.streaming.published import Published

REPOSITORIES = "repo_id long, status string, indexed string, head string, running string, action string"
FEED = f"{PUSH}, registered boolean, run struct<repo_id: bigint, commit_sha: string, ok: boolean>"


def control(root: str, buckets: int = 64) -> Published:
    return Published(root, {"repositories": (REPOSITORIES, "repo_id")}, buckets)


def of_feed(feed: DataFrame, place: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registered, pushes, outcomes) of a feed (FEED and a place): (repo_id), (repo_id, commit_sha, place), (repo_id, commit_sha, ok, place). Rows without a repository say nothing."""
    registered = feed.filter("registered").select(F.col("repository.id").alias("repo_id"))
    pushes = default_branch_pushes(feed.filter("after is not null"), place).select(F.col("github_repo_id").alias("repo_id"), "commit_sha", F.col(place).alias("place"))
    outcomes = feed.filter("run is not null").select("run.repo_id", "run.commit_sha", "run.ok", F.col(place).alias("place"))
    return tuple(rows.filter("repo_id is not null") for rows in (registered, pushes, outcomes))


def moved(current: DataFrame, registered: DataFrame, pushes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """`current` (REPOSITORIES) after a batch of `of_feed`: registrations, then outcomes, then the last push of each repository.

    action is what the batch did to a row: initial or delta (a run started, of the commit in `running`), already_indexing, up_to_date, finished, or null. A run is over when an outcome names its
    commit, by the last one that does; one without `ok` is a failure. Pushes and outcomes of repositories that are not registered say nothing; repeated registrations neither.
    """
    names = ["repo_id", "status", "indexed", "head", "running"]
    fresh = registered.select("repo_id").distinct().join(current.select("repo_id"), "repo_id", "left_anti")
    fresh = fresh.select("repo_id", F.lit("NEW").alias("status"), *[F.lit(None).cast("string").alias(n) for n in names[2:]])
    rows = current.select(*names).unionByName(fresh)
    heads = pushes.groupBy("repo_id").agg(F.max_by("commit_sha", "place").alias("_pushed"))
    over = outcomes.join(rows.filter("status = 'INDEXING'").select("repo_id", F.col("running").alias("commit_sha")), ["repo_id", "commit_sha"])
    over = over.groupBy("repo_id").agg(F.max_by(F.coalesce("ok", F.lit(False)), "place").alias("_ok"))
    rows = rows.join(heads, "repo_id", "left").join(over, "repo_id", "left")

    done, pushed = F.col("_ok").isNotNull(), F.col("_pushed").isNotNull()
    rows = rows.withColumns({
        "_indexed": F.when(F.col("_ok"), F.col("running")).otherwise(F.col("indexed")), "_head": F.coalesce("_pushed", "head"),
        "_status": F.when(done & F.col("_ok"), "INDEXED").when(done, "FAILED").otherwise(F.col("status")),
    })
    asked = pushed | (done & ~F.col("head").eqNullSafe(F.col("running")))
    idle = F.col("_status") != "INDEXING"
    due = idle & asked & F.col("_head").isNotNull() & ~F.col("_head").eqNullSafe(F.col("_indexed"))
    action = (
        F.when(due & F.col("_indexed").isNull(), "initial").when(due, "delta").when(pushed & ~idle, "already_indexing").when(pushed, "up_to_date").when(done, "finished")
    )
    return rows.select(
        "repo_id", F.when(due, "INDEXING").otherwise(F.col("_status")).alias("status"), F.col("_indexed").alias("indexed"), F.col("_head").alias("head"),
        F.when(due, F.col("_head")).when(~idle, F.col("running")).alias("running"), action.alias("action"),
    )


def due(table: Published, spark: SparkSession) -> DataFrame:
    """(repo_id, commit_sha, indexed): the runs that are on; a worker that starts again reads the same ones."""
    return table.read(spark, "repositories").filter("status = 'INDEXING'").select("repo_id", F.col("running").alias("commit_sha"), "indexed")


def apply_feed(table: Published, batch: DataFrame, number: int) -> bool:
    """Publish the control table after a batch, if it wasn't before. The feed's order is (landed_at, landed_file, order in the file) where the batch has these columns."""
    marks = [c for c in ("landed_at", "landed_file") if c in batch.columns]
    placed = batch.withColumn("_line", F.monotonically_increasing_id()).withColumn("_place", F.struct(*marks, "_line")).persist()
    parts = of_feed(placed, "_place")
    keys = parts[0].unionByName(parts[1].select("repo_id")).unionByName(parts[2].select("repo_id"))
    published = table.publish(batch.sparkSession, number, {"repositories": (keys, lambda current: moved(current, *parts))})
    placed.unpersist()
    return published


def start_pushes(spark: SparkSession, landing: str, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Apply all landed feed files (JSON lines of FEED) that are new since the last call, then stop."""
    table = control(root, buckets)
    feed = spark.readStream.schema(FEED).json(landing).select("*", F.col("_metadata.file_modification_time").alias("landed_at"), F.col("_metadata.file_name").alias("landed_file"))
    write = feed.writeStream.foreachBatch(lambda batch, number: apply_feed(table, batch, number) and None)
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
