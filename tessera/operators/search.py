"""Exact nearest-vector search and the retrieval plans built on it.

Vectors are compared with a few query vectors given as values, so the corpus is scanned once without a join or a
shuffle; metadata filters apply before any similarity is computed, and a top-k is one bounded heap per task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, norm


@dataclass(frozen=True)
class Limits:
    """What a retrieval may return."""

    components: int = 3
    files: int = 5
    chunks: int = 10
    threshold: float = 0.6
    hits: int = 10


def literal(vector: Sequence[float]) -> Column:
    """One array literal, however wide."""
    return F.from_json(F.lit(json.dumps([float(x) for x in vector])), "array<double>")


def with_similarity(rows: DataFrame, query: Sequence[float], vector: str = "embedding", digits: int = 6) -> DataFrame:
    """`rows` with similarity (rounded, so that a threshold doesn't hang on the order of additions), which replaces a column of that name; rows with a zero or null vector go."""
    asked = literal(query)
    similarity = dot(F.col(vector), asked) / F.nullif(norm(F.col(vector)) * F.lit(math.sqrt(sum(float(x) ** 2 for x in query))), F.lit(0.0))
    return rows.withColumn("similarity", F.round(similarity, digits)).filter("similarity is not null")


def top_k(rows: DataFrame, query: Sequence[float], k: int | None, threshold: float | None, key: str, vector: str = "embedding") -> DataFrame:
    """The k most similar rows at or above the threshold, ties by key. None means no limit or threshold; 0 is a value."""
    found = with_similarity(rows, query, vector)
    if threshold is not None:
        found = found.filter(F.col("similarity") >= threshold)
    found = found.orderBy(F.desc("similarity"), key)
    return found if k is None else found.limit(k)


#: So many query vectors at most travel to the rows as a value; more of them meet the rows in a shuffle.
TRAVELLING = 4096


def top_k_each(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", names: tuple[str, str, str] = ("query_id", "rank", "similarity")) -> DataFrame:
    """top_k for a table of queries (key, vector) at once: the query's key, rank and similarity, under `names`, and the row. A query's own row is left out.

    `names` must differ from the columns of `rows`. Queries travel in blocks of TRAVELLING, each one scan of the rows, which stay where they are: a task keeps the k best of
    each query and sends those alone. Rows are fetched for what is left. Zero and null vectors, and null keys, take no part.
    """
    query_id, rank, similarity = names
    asked = queries.filter(F.col(key).isNotNull() & (norm(F.col(vector)) > 0)).select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // TRAVELLING))
    best = None
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toPandas()  # about TRAVELLING rows
        found = _best_of_tasks(rows.select(F.col(key).cast("long").alias("r"), F.col(vector).cast("array<double>").alias("v")).filter("r is not null and v is not null"), block, k)
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("q").orderBy(F.desc("s"), "r")
    best = best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    best = best.select(F.col("q").alias(query_id), F.col("n").alias(rank), F.col("r").alias(f"{query_id}_r"), F.col("s").alias(similarity))
    return best.join(rows, F.col(f"{query_id}_r") == F.col(key).cast("long")).drop(f"{query_id}_r")


def _best_of_tasks(rows: DataFrame, block: pd.DataFrame, k: int) -> DataFrame:
    """(q, r, s): of each task's rows (r, v) the k with the highest similarity s to each query (q, v) of the block, ties to the smaller r."""
    ids = block["q"].to_numpy(dtype=np.int64)
    asked = [np.asarray(v, dtype=float) for v in block["v"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for pdf in batches:
            for size, same in pdf.groupby(pdf["v"].map(len)):
                at = [i for i, v in enumerate(asked) if len(v) == size]
                data = np.stack([np.asarray(v, dtype=float) for v in same["v"]]) if size and at else np.zeros((0, 0))
                length = np.sqrt((data * data).sum(axis=1)) if len(data) else np.zeros(0)
                data, r, length = data[length > 0], same["r"].to_numpy()[: len(length)][length > 0], length[length > 0]
                for first in range(0, len(at) if len(data) else 0, 256):
                    part = at[first : first + 256]
                    q = np.stack([asked[i] for i in part])
                    s = np.round(q @ data.T / (np.sqrt((q * q).sum(axis=1))[:, None] * length), 6)
                    s[ids[part][:, None] == r] = -np.inf
                    floor = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])] if k else np.full(len(q), np.inf)
                    i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
                    new = pd.DataFrame({"q": ids[part][i], "r": r[j], "s": s[i, j]})
                    kept = new if kept is None else pd.concat([kept, new])
            if kept is not None and len(kept) > 4 * k * max(1, len(ids)):
                kept = kept.sort_values(["q", "s", "r"], ascending=[True, False, True]).groupby("q").head(k)
        if kept is not None:
            yield kept.sort_values(["q", "s", "r"], ascending=[True, False, True]).groupby("q").head(k)

    return rows.mapInPandas(run, "q long, r long, s double").withColumn("s", F.round("s", 6))


def restricted(rows: DataFrame, column: str, keys: DataFrame | Sequence | None) -> DataFrame:
    """Rows whose column is among the keys; None or an empty list restricts nothing."""
    if isinstance(keys, DataFrame):
        return rows.join(keys.select(column).distinct(), column, "left_semi")
    return rows.filter(F.col(column).isin(list(keys))) if keys else rows


def looked_up(rows: DataFrame, column: str, keys: Sequence) -> DataFrame:
    """Rows by exact key, similarity 1; an empty list finds nothing."""
    return (rows.filter(F.col(column).isin(list(keys))) if keys else rows.limit(0)).withColumn("similarity", F.lit(1.0))


def first_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def unrestricted(rows: DataFrame, query: Sequence[float], key: str, limits: Limits) -> DataFrame:
    """Chunks among all rows, whatever their similarity, marked as fallback."""
    return top_k(rows, query, limits.chunks, None, key).withColumn("fallback", F.lit(True))


def hierarchical(rows: DataFrame, query: Sequence[float], key: str, component: str, limits: Limits) -> DataFrame:
    """Hits, the first files of the best components, then chunks among all these; unrestricted where nothing hits.

    The chunk search sees every collected path, even where the list of files returned is cut.
    """
    hits = top_k(rows, query, limits.hits, limits.threshold, key).select(key, component, "similarity").collect()  # at most limits.hits rows
    if not hits:
        return unrestricted(rows, query, key, limits)
    best: dict = {}
    for r in hits:
        best[r[component]] = max(best.get(r[component], -2.0), r["similarity"])
    components = sorted((c for c in best if c is not None), key=lambda c: (-best[c], c))[: limits.components]
    children = first_of_each(rows.filter(F.col(component).isin(components)).select(key, component), component, key, limits.files).collect()  # components x files rows
    paths = list({r[key] for r in [*hits, *children]})
    return top_k(rows.filter(F.col(key).isin(paths)), query, limits.chunks, None, key).withColumn("fallback", F.lit(False))
