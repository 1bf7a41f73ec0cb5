"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Scope:
    """The tables that operators stored while it was the current one (`with scope():`); a run that clears them leaves those of others alone."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def clear(self, spark: SparkSession, keep: DataFrame | None = None) -> None:
        """Delete the scope's tables, but for the files that `keep` reads. Call it once results are written: until then they may be read."""
        kept = keep.inputFiles() if keep is not None else []
        for path in list(self.paths):
            if not any(path.split("/")[-1] in file for file in kept):
                self.paths.remove(path)
                _delete(spark, path)

    def __enter__(self) -> Scope:
        self._token = _SCOPE.set(self)
        _SCOPES.add(self)
        return self

    def __exit__(self, *_: object) -> None:
        _SCOPE.reset(self._token)


#: Tables stored outside of any scope; the current scope, per thread; all scopes whose tables may still be there.
_COMMON = Scope()
_SCOPE: ContextVar[Scope] = ContextVar("scope", default=_COMMON)
_SCOPES: weakref.WeakSet[Scope] = weakref.WeakSet([_COMMON])


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table_ in tables:
        for path in {file.rsplit("/", 1)[0] for file in table_.inputFiles()}:
            for held in list(_SCOPES):
                for known in [p for p in held.paths if path.endswith(p.split("/")[-1])]:
                    held.paths.remove(known)
                    _delete(table_.sparkSession, known)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is missing and Spark runs in this one process (a local test session) a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    _SCOPE.get().paths.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: its lineage ends there,
    later jobs read the files, and a lost executor costs only its running tasks."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame | list[str], *bases: str) -> list[str]:
    """Column names close to `bases` that `df` (or a list of names) does not have."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    out = []
    for base in bases:
        while base.lower() in taken:
            base += "_"
        taken.add(base.lower())
        out.append(base)
    return out


#: Keys with more than one part in this of all rows are dealt to several tasks by `spread_join`; so few rows in all are no burden under one key.
HOT_PARTS, HOT_FLOOR = 512, 8192


def spread_join(rows: DataFrame, looked_up: DataFrame, key: str, dealt_by: list[str], counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """`rows` joined to `looked_up` on `key`, which is unique there, so that no key gathers its rows in one task.

    A key that holds more than 1 / HOT_PARTS of the rows is hot; there are at most about HOT_PARTS of them, so their list is
    broadcast. Their rows get a salt, a hash of `dealt_by`, and their looked-up row is copied to each salt. `counted`: a stored table with the keys of `rows`,
    if that is cheaper to count than `rows`.
    """
    counted = rows if counted is None else counted
    total = counted.count()
    if total <= HOT_FLOOR:
        return rows.join(looked_up, key, how)
    share = total // HOT_PARTS
    copies, salt = free_names([*rows.columns, *looked_up.columns], "copies_", "salt_")
    hot = counted.groupBy(key).count().filter(F.col("count") > share).select(key, F.ceil(F.col("count") / share).cast("int").alias(copies))
    hot = F.broadcast(hot)  # about HOT_PARTS rows at most
    of_row = F.pmod(F.xxhash64(*dealt_by), F.coalesce(copies, F.lit(1))).cast("int")
    left = rows.join(hot, key, "left").withColumn(salt, of_row).drop(copies)
    right = looked_up.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1))).drop(copies)
    return left.join(right, [key, salt], how).drop(salt)


#: Bits of the filter of `sifted`: so many for each wanted key, that number at least, and that at most (8 MB in all).
SIFT_BITS, SIFT_LEAST, SIFT_MOST = 16, 1 << 21, 1 << 26


def sifted(rows: DataFrame, wanted: DataFrame, key: str, n_wanted: int) -> DataFrame:
    """Those `rows` whose key is in `wanted` (a stored table with `n_wanted` rows), and a few others: wide rows that an exact join would drop afterwards needn't travel to it.

    The filter is a table of bitmaps, one bit for each hash of a key, which is broadcast whole; where there are more keys than it has room for, more rows pass.
    """
    bits = min(SIFT_MOST, max(SIFT_LEAST, SIFT_BITS * n_wanted))
    bucket, place, bitmap = free_names([*rows.columns, *wanted.columns], "bucket_", "place_", "bitmap_")
    hashed = F.pmod(F.xxhash64(key), F.lit(bits))
    placed = lambda df: df.withColumns({bucket: F.bitmap_bucket_number(hashed), place: F.bitmap_bit_position(hashed)})
    bitmaps = placed(wanted.select(key)).repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(bitmap))
    byte = F.conv(F.hex(F.substr(bitmap, (F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = placed(rows).join(F.broadcast(bitmaps), bucket)  # SIFT_MOST bits at most
    return found.filter(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1).select(*rows.columns)


def parts_of(size: str, total: int) -> Column:
    """The number of tasks to which a key with `size` (a column) of all `total` rows is dealt: one, if it holds no more than 1 / HOT_PARTS of them."""
    return F.lit(1) if total <= HOT_FLOOR else F.ceil(F.col(size) / (total // HOT_PARTS)).cast("int")


def dealt_join(rows: DataFrame, looked_up: DataFrame, key: str, dealt_by: list[str], parts: str) -> DataFrame:
    """`spread_join` for rows that know already, as the looked-up ones do, to how many tasks their key is dealt (column `parts`): nothing is counted or joined for that."""
    (salt,) = free_names([*rows.columns, *looked_up.columns], "salt_")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*dealt_by), F.col(parts)).cast("int"))
    right = looked_up.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return left.join(right, [key, salt]).drop(salt)


def ranked_sample(rows: DataFrame, group: str, text: str, per_group: int) -> list[tuple[str, object]]:
    """At most `per_group` distinct (text, group) of each group, those whose texts hash lowest: the same in every run, however often a text repeats.

    Ranks are taken on hashes, each task sends at most `per_group` of a group; only the chosen texts are fetched.
    """
    hashed = rows.select(F.col(group).alias("group"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    order = Window.partitionBy("group").orderBy("h")
    chosen = hashed.select("group", "h").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_group).select("group", "h")
    found = hashed.join(F.broadcast(chosen), ["group", "h"]).groupBy("group", "h").agg(F.min("text").alias("text"))  # groups x per_group rows
    return [(r["text"], r["group"]) for r in sorted(found.collect(), key=lambda r: (str(r["group"]), r["h"]))]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
