"""Declared tables: columns, partitions and buckets stated once, created by DDL, filled so that a hot partition is many files.

Filters and joins on a partition column choose folders before anything is read; joins and groupings on the key of buckets need no shuffle.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Layout:
    """`schema` (DDL columns, in order; partition columns among them), columns that are folders, and a key dealt into `buckets`.

    Partition columns should have few values (a folder each), a key of buckets nearly as many as there are rows: a bucket is one task for those who read by it.
    """

    schema: str
    partitions: tuple[str, ...] = ()
    key: str | None = None
    buckets: int = 64

    def columns(self) -> list[str]:
        """All columns in the order in which the table has them: partition columns last."""
        names = StructType.fromDDL(self.schema).names
        return [n for n in names if n not in self.partitions] + list(self.partitions)

    def ddl(self, name: str, location: str) -> str:
        quoted = ", ".join(f"`{p}`" for p in self.partitions)
        folders = f" PARTITIONED BY ({quoted})" if self.partitions else ""
        dealt = f" CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS" if self.key else ""
        return f"CREATE TABLE IF NOT EXISTS {name} ({self.schema}) USING parquet{folders}{dealt} LOCATION '{location}'"


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share. Where the setting is missing, a local master takes a temporary folder; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/layout-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def declare(spark: SparkSession, layouts: dict[str, Layout], root: str) -> list[str]:
    """Create those of the tables (name -> Layout) that are not there, under `root`; the names of the new ones. To be run again at any time."""
    new = [name for name in layouts if not spark.catalog.tableExists(name)]
    for name in new:
        spark.sql(layouts[name].ddl(name, f"{root.rstrip('/')}/{name.split('.')[-1]}"))
    return new


def fill(spark: SparkSession, name: str, layout: Layout, rows: DataFrame, replace: bool = False) -> None:
    """Append `rows` to a declared table; with `replace`, the partitions that occur in `rows` are replaced and all others stay (without partitions, the table).

    A task writes rows of few partitions, and a partition of many rows is dealt to several tasks. Rows whose partition is null have a folder of their own. Columns beyond the schema are left
    out, a missing one is an error, as is a value that its column's type cannot hold. `replace` of no rows replaces nothing in a partitioned table. One writer at a time.
    """
    dealt = [layout.key] if layout.key else list(layout.partitions)
    rows = rows.select(*[f"`{c}`" for c in layout.columns()])
    rows = rows.hint("rebalance", *dealt) if dealt else rows
    with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        rows.write.insertInto(name, overwrite=replace)


def stored_as(rows: DataFrame, layout: Layout) -> DataFrame:
    """`rows` written once under a layout, in the shared folder, and read again: a table without a name of its own."""
    spark = rows.sparkSession
    name, folder = f"layout_{uuid.uuid4().hex}", shared_folder(spark)
    declare(spark, {name: layout}, folder)
    fill(spark, name, layout, rows)
    return spark.table(name)
