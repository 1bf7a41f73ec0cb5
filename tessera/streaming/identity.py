"""Identity changes applied in the order of their sequence, in whatever order they arrive.

Each user is a key with state: the sequence of the last change applied, and whether it deleted the user. Deleted users stay behind as tombstones, so that
a late update with a smaller sequence does not bring them back; one with a larger sequence does. Deliveries that repeat change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.sources.landed import IDENTITY, users
from tessera.streaming.published import Published
from tessera.streaming.state import keyed_state, with_stores

CHANGES = "external_id string, sequence long, deleted boolean, email string, name string"
USERS = "external_id string, sequence long, email string, name string"


class LastChange(StatefulProcessor):
    """Keeps (sequence, deleted) of a key; gives the change that moves it on, if there is one among the rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence long, deleted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        best = None
        for pdf in rows:
            # Of two changes with one sequence a deletion counts, then the later text: the same whatever the order of rows.
            top = pdf[pdf["sequence"] == pdf["sequence"].max()].sort_values(["deleted", "email", "name"], na_position="first").tail(1)
            if best is None or self._order(top) > self._order(best):
                best = top
        if best is not None and (not self.last.exists() or int(best["sequence"].iloc[0]) > self.last.get()[0]):
            self.last.update((int(best["sequence"].iloc[0]), bool(best["deleted"].iloc[0])))
            yield best

    @staticmethod
    def _order(row: pd.DataFrame) -> tuple:
        return (int(row["sequence"].iloc[0]), bool(row["deleted"].iloc[0]), row["email"].iloc[0] or "", row["name"].iloc[0] or "")

    def close(self) -> None:
        pass


def identity_changes(events: DataFrame, sequence: str = "sequence") -> DataFrame:
    """CHANGES of an identity feed (IDENTITY and a sequence); other kinds of events, and rows without id or sequence, say nothing."""
    both = events.withColumn("_sequence", F.col(sequence).cast("long"))
    kept = users(both, "_sequence")
    return kept.filter("external_id is not null and sequence is not null")


def last_changes(changes: DataFrame) -> DataFrame:
    """The changes (CHANGES) that count, one per user and batch; of a table as of a stream, in update mode. Rows without external_id or sequence are left out."""
    with_stores(changes.sparkSession)
    known = changes.select(*[c.split()[0] for c in CHANGES.split(", ")]).filter("external_id is not null and sequence is not null")
    return known.groupBy("external_id").transformWithStateInPandas(LastChange(), CHANGES, "Update", "None")


def applied(current: DataFrame, changes: DataFrame) -> DataFrame:
    """`current` users (USERS) after changes of which each user has one at most; a user's row never gives way to one with a smaller sequence."""
    new = changes.select("external_id", F.col("sequence").alias("_sequence"), "deleted", F.col("email").alias("_email"), F.col("name").alias("_name"))
    both = current.join(new, "external_id", "full_outer")
    fresh = F.col("_sequence").isNotNull() & (F.col("sequence").isNull() | (F.col("_sequence") > F.col("sequence")))
    row = [F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("sequence", "email", "name")]
    return both.filter(~(fresh & F.col("deleted"))).select("external_id", *row)


def user_table(root: str, buckets: int = 64) -> Published:
    return Published(root, {"users": (USERS, "external_id")}, buckets)


def start_users(spark: SparkSession, landing: str, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Apply all landed identity events (JSON lines of IDENTITY with a sequence) that are new since the last call, then stop."""
    table = user_table(root, buckets)
    changes = last_changes(identity_changes(spark.readStream.schema(f"{IDENTITY}, sequence long").json(landing)))

    def publish(batch: DataFrame, number: int) -> None:
        batch.persist()
        table.publish(batch.sparkSession, number, {"users": (batch, lambda current: applied(current, batch))})
        batch.unpersist()

    with keyed_state(spark):
        return changes.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
