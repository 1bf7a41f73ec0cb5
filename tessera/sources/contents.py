"""Raw contents of files below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_below(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, content): all files below `root`, at any depth, as UTF-8 text under their paths from there; with a `glob`, those whose names match it are read alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = F.lit(f"/{root.split('://', 1)[-1].strip('/').rsplit('/', 1)[-1]}/")
    below = F.col("path").substr(F.instr("path", base) + F.length(base), F.length("path"))
    return rows.select(below.alias("path"), F.decode("content", "UTF-8").alias("content"))


def contents_of(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """`wanted` rows (path) with the content of their file; null where there is none."""
    found = files.select("path", "content")
    return wanted.join(found, "path", "left")
