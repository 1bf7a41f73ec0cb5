"""A summary tree that is regenerated only where hashes changed: file, component, architecture, repository."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.delta import delete, upsert
from tessera.operators.structure import parent_hashes
from tessera.streaming.published import Published

NODE = ["node_type", "node_key"]


def wanted_nodes(files: DataFrame) -> DataFrame:
    """(node_type, node_key, parent_key, content_hash) of all levels, from files (path, module, hash). Two groupings by module, two of modules."""
    leaf = files.select(F.lit("file").alias("node_type"), F.col("path").alias("node_key"), F.col("module").alias("parent_key"), F.col("hash").alias("content_hash"))
    parts = parent_hashes(files, "module", "hash").select(F.lit("component").alias("node_type"), F.col("module").alias("node_key"), F.lit("architecture").alias("parent_key"), F.col("hash").alias("content_hash"))
    whole = parent_hashes(parts, "parent_key", "content_hash").select(F.lit("architecture").alias("node_type"), F.lit("architecture").alias("node_key"), F.lit("repository").alias("parent_key"), F.col("hash").alias("content_hash"))
    root = parent_hashes(whole, "parent_key", "content_hash").select(F.lit("repository").alias("node_type"), F.lit("repository").alias("node_key"), F.lit(None).cast("string").alias("parent_key"), F.col("hash").alias("content_hash"))
    return leaf.unionByName(parts).unionByName(whole).unionByName(root)


def stale_nodes(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted nodes that are not stored with the same hash: only these need a model call."""
    return wanted.join(stored.select(*NODE, "content_hash"), [*NODE, "content_hash"], "left_anti")


def refreshed(stored: DataFrame, wanted: DataFrame, regenerated: DataFrame) -> DataFrame:
    """The tree afterwards: regenerated nodes replace old ones, nodes that are not wanted any more go, emptied components among them."""
    merged = upsert(stored.withColumn("_v", F.lit(0)), regenerated.select(*stored.columns).withColumn("_v", F.lit(1)), NODE, [F.desc("_v")]).drop("_v")
    gone = merged.select(*NODE).join(wanted.select(*NODE), NODE, "left_anti")
    return delete(merged, gone, NODE)


SUMMARY = "node_type string, node_key string, parent_key string, content_hash string, summary string"


@dataclass(frozen=True)
class SummaryStore:
    """The stored tree, in buckets of the node's key; runs are numbered, and a run that comes again changes nothing."""

    root: str
    buckets: int = 64

    def _table(self) -> Published:
        return Published(self.root, {"summaries": (SUMMARY, "node_key")}, self.buckets)

    def nodes(self, spark: SparkSession, node_type: str | None = None, key: str | None = None) -> DataFrame:
        """All nodes, those of a type, or the one with a key, which is read from its bucket alone."""
        table, only = self._table(), None
        if key is not None:
            only = {spark.range(1).select(F.lit(key).alias("k")).select(table.bucket("k")).first()[0]}
        rows = table.read(spark, "summaries", only)
        rows = rows if node_type is None else rows.filter(F.col("node_type") == node_type)
        return rows if key is None else rows.filter(F.col("node_key") == key).limit(1)

    def put(self, run: int, changed: DataFrame, gone: DataFrame) -> bool:
        """Write `changed` nodes over those of their keys and delete `gone` ones (NODE)."""
        keys = changed.select("node_key").unionByName(gone.select("node_key"))

        def change(current: DataFrame) -> DataFrame:
            fresh = changed.select(*current.columns)
            return delete(delete(current, gone, NODE), fresh, NODE).unionByName(fresh)

        return self._table().publish(changed.sparkSession, run, {"summaries": (keys, change)})


@dataclass(frozen=True)
class SummaryPipeline:
    """Brings a store up to date: `write` adds summaries to the stale nodes that it is given; `refine`, if there is one, gives files other modules first."""

    store: SummaryStore
    write: Callable[[DataFrame], DataFrame]
    refine: Callable[[DataFrame], DataFrame] | None = None

    def run(self, number: int, files: DataFrame) -> bool:
        """Files (path, module, hash); only nodes whose hash is new are written, and nodes that are not wanted any more go."""
        spark = files.sparkSession
        wanted = wanted_nodes(self.refine(files) if self.refine else files)
        stored = self.store.nodes(spark)
        gone = delete(stored.select(*NODE), wanted, NODE)
        return self.store.put(number, self.write(stale_nodes(stored, wanted)), gone)
