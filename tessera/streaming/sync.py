"""Incremental indexing of a change feed with Structured Streaming.

Chunks lie in buckets of a hash of their path (`published`): a micro-batch reads and writes the buckets of the paths it changes, old names of renamed
files among them, and becomes visible as a whole. A batch that runs again after a failure leaves the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.chunking import line_windows
from tessera.operators.delta import apply_diff, delete
from tessera.sources.landed import CHANGE
from tessera.streaming.published import Published

INDEX = "path string, content_hash string, content string, first_line int, last_line int, commit_sha string"


def index(root: str, buckets: int = 64) -> Published:
    """The chunk index under `root`."""
    return Published(root, {"chunks": (INDEX, "path")}, buckets)


def chunks_of(files: DataFrame, size: int, overlap: int) -> DataFrame:
    parts = line_windows(files.filter("length(content) > 0").select("path", "content", "commit_sha").withColumnRenamed("content", "_text"), "_text", size, overlap)
    return parts.select("path", F.sha2("content", 256).alias("content_hash"), "content", "first_line", "last_line", "commit_sha")


def final_states(changes: DataFrame) -> DataFrame:
    """(path, place, gone, content, commit_sha): what the last change of a batch did to each path.

    A rename is two changes at one place in the feed: its old path goes, its new one has the content. So a path that was renamed away stays away whatever happens to the new one,
    and comes back if a later row gives it content. The place is (landed_at, landed_file, place) where the batch has these columns, else the order of its rows; rows without path say nothing.
    """
    if "place" not in changes.columns:
        changes = changes.withColumn("place", F.monotonically_increasing_id())
    place = F.struct(*[c for c in ("landed_at", "landed_file", "place") if c in changes.columns])
    told = changes.select("path", place.alias("place"), (F.col("status") == "removed").alias("gone"), "content", "commit_sha", "status", "previous_path")
    away = told.filter("status = 'renamed' and previous_path is not null and not previous_path <=> path")
    away = away.select(F.col("previous_path").alias("path"), "place", F.lit(True).alias("gone"), F.lit(None).cast("string").alias("content"), "commit_sha")
    both = told.select("path", "place", "gone", "content", "commit_sha").unionByName(away).filter("path is not null")
    last = both.groupBy("path").agg(F.max_by(F.struct("place", "gone", "content", "commit_sha"), F.struct("place", ~F.col("gone"))).alias("x"))
    return last.select("path", "x.*")


def indexed(current: DataFrame, changes: DataFrame, size: int = 200, overlap: int = 10) -> DataFrame:
    """The index after a batch of changes (path, content, status, previous_path, commit_sha), by the last state of each path (`final_states`).

    Removed, emptied and renamed-away paths lose their chunks; unchanged chunks of a changed file are only stamped with the batch's last commit.
    """
    last = final_states(changes)
    head = last.agg(F.max_by("commit_sha", "place").alias("sha")).first()["sha"]
    new = chunks_of(last.filter("not gone"), size, overlap)
    touched = current.join(last.select("path"), "path", "left_semi")
    merged = apply_diff(touched, new, ["path", "content_hash"], {}).withColumn("commit_sha", F.lit(head).cast("string"))
    return delete(current, last, ["path"]).unionByName(merged.select(*current.columns))


def apply_batch(table: Published, batch: DataFrame, number: int, size: int = 200, overlap: int = 10) -> bool:
    """Publish the index after a batch, if it wasn't before."""
    paths = batch.select("path").unionByName(batch.select(F.col("previous_path").alias("path"))).filter("path is not null")
    batch.persist()
    done = table.publish(batch.sparkSession, number, {"chunks": (paths, lambda current: indexed(current, batch, size, overlap))})
    batch.unpersist()
    return done


def start_sync(spark: SparkSession, landing: str, root: str, checkpoint: str, size: int = 200, overlap: int = 10, buckets: int = 64) -> StreamingQuery:
    """Index all landed change files that are new since the last call, then stop."""
    table = index(root, buckets)
    feed = spark.readStream.schema(CHANGE).json(landing).select("*", F.col("_metadata.file_modification_time").alias("landed_at"), F.col("_metadata.file_name").alias("landed_file"))
    write = feed.writeStream.foreachBatch(lambda batch, number: apply_batch(table, batch, number, size, overlap) and None)
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
