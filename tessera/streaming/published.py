"""Keyed tables that change together: a batch writes the buckets it touches, and one marker makes all of them visible at once.

    root/<table>/batch=<n>/bucket=<b>/   rows of bucket b as batch n left them; written once, never changed
    root/_published/<n>/                 (name, bucket, batch): where each bucket's rows are after batch n

Readers take the newest marker that was written to its end (_SUCCESS), and only the folders that it names. So a batch that fails at any
point, between two tables too, leaves nothing to be seen, a batch that is run again writes the same folders again or, once published, does nothing, and a batch of one key
reads and writes one bucket however large the table is. Markers hold a row per bucket. There is one writer, as a streaming query is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a batch does to a table: the keys it touches, and a function from the present rows of their buckets to the new rows.
Change = tuple[DataFrame, Callable[[DataFrame], DataFrame]]


@dataclass(frozen=True)
class Published:
    """Tables under `root`: name -> (schema, key column). `buckets` must stay what it was when the first batch was published."""

    root: str
    tables: dict[str, tuple[str, str]]
    buckets: int = 64

    def _files(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def last(self, spark: SparkSession) -> int | None:
        """The number of the newest published batch."""
        files, path = self._files(spark)
        if not files.exists(path(f"{self.root}/_published")):
            return None
        numbers = [int(s.getPath().getName()) for s in files.listStatus(path(f"{self.root}/_published"))]
        return max((n for n in numbers if files.exists(path(f"{self.root}/_published/{n}/_SUCCESS"))), default=None)

    def places(self, spark: SparkSession, number: int | None = None) -> dict[tuple[str, int], int]:
        """(table, bucket) -> batch that wrote it last; as published by batch `number`, by default the newest."""
        number = self.last(spark) if number is None else number
        if number is None:
            return {}
        rows = spark.read.schema("name string, bucket int, batch long").parquet(f"{self.root}/_published/{number}").collect()  # a row per table and bucket
        return {(r["name"], r["bucket"]): r["batch"] for r in rows}

    def bucket(self, key: str) -> Column:
        """Null keys have a bucket like any other."""
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, name: str, only: set[int] | None = None) -> DataFrame:
        """The published rows of a table, or those of some of its buckets; empty before the first batch."""
        places = {b: n for (t, b), n in self.places(spark).items() if t == name and (only is None or b in only)}
        return self._rows(spark, name, places)

    def _rows(self, spark: SparkSession, name: str, places: dict[int, int]) -> DataFrame:
        schema, base = self.tables[name][0], f"{self.root}/{name}"
        if not places:
            return spark.createDataFrame([], schema)
        files, path = self._files(spark)
        found = [p for b, n in sorted(places.items()) if files.exists(path(p := f"{base}/batch={n}/bucket={b}"))]  # a bucket that lost all rows has no folder
        return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)

    def publish(self, spark: SparkSession, number: int, changes: dict[str, Change]) -> bool:
        """Apply a batch to all tables that `changes` names; False, and nothing is done, if it was published before."""
        last = self.last(spark)
        if last is not None and number <= last:
            return False
        places = self.places(spark, last)
        for name, (keys, change) in changes.items():
            schema, key = self.tables[name]
            touched = {r[0] for r in keys.select(self.bucket(key)).distinct().collect()}  # at most `buckets` numbers
            new = change(self._rows(spark, name, {b: n for (t, b), n in places.items() if t == name and b in touched}))
            rows = new.select(*spark.createDataFrame([], schema).columns).withColumn("bucket", self.bucket(key)).filter(F.col("bucket").isin(*touched) if touched else F.lit(False))
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/batch={number}")
            places |= {(name, b): number for b in touched}
        marker = spark.createDataFrame([(t, b, n) for (t, b), n in sorted(places.items())], "name string, bucket int, batch long")
        marker.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_published/{number}")
        return True

    def vacuum(self, spark: SparkSession, keep: int = 1) -> int:
        """Delete markers older than the newest `keep`, and folders that none of those names; how many folders went. Readers of older markers must have ended."""
        files, path = self._files(spark)
        last = self.last(spark)
        if last is None:
            return 0
        numbers = sorted((int(s.getPath().getName()) for s in files.listStatus(path(f"{self.root}/_published"))), reverse=True)
        kept = [n for n in numbers if n <= last][:keep]
        named = {f"{t}/batch={n}/bucket={b}" for k in kept for (t, b), n in self.places(spark, k).items()}
        gone = 0
        for n in [n for n in numbers if n < min(kept)]:
            files.delete(path(f"{self.root}/_published/{n}"), True)
        for name in self.tables:
            for batch in files.globStatus(path(f"{self.root}/{name}/batch=*")) or []:
                if int(batch.getPath().getName().removeprefix("batch=")) <= last:
                    for folder in files.globStatus(path(f"{batch.getPath().toString()}/bucket=*")) or []:
                        if f"{name}/{batch.getPath().getName()}/{folder.getPath().getName()}" not in named:
                            files.delete(folder.getPath(), True)
                            gone += 1
        return gone
