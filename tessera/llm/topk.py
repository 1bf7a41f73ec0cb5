"""Exact top-k inner product by a vector-approximation file.

The approximation file keeps each vector as one cell number per dimension, blocks of vectors with the corners and widths of their
cells. Exact vectors are stored apart from it and are read for candidates alone.

  1. Cells are scanned: every block of queries meets the blocks of a group of cell blocks, one after the other and SLICE queries at once. The cells bound each
     score from both sides. A task keeps, for each of its queries, the k best lower bounds seen so far and the vectors whose upper bounds reach the k-th of them.
  2. The k-th best lower bound over all groups is the query's threshold; candidates below it go.
  3. Exact vectors are read in the order of the bounds: first those of the k candidates with the best upper bounds. Their
     k-th exact score is the new threshold, and only candidates whose upper bound reaches it are read then. After that the k-th is certain.

Blocks hold a bounded number of vectors, whichever ids repeat. (block of queries, group of cell blocks) is the unit of work, so
there are as many tasks as there are such pairs, and no join has a key with more rows than a group has blocks. Where queries are many, a block holds
QUERY_BLOCK of them, so that cells travel once for all of these; where they are few, blocks are smaller, so that all tasks have work. A vector
that is a candidate of very many queries is fetched in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_width, spread_join, stored

#: Vectors in a block of cells, queries in a block at most, queries that meet a block of cells at once, cell blocks in a group, bits of a cell.
BLOCK, QUERY_BLOCK, SLICE, GROUP, BITS = 4096, 16384, 1024, 16, 6
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component as double.

    Null or empty vectors and those that hold null, NaN or infinite components take no part, nor do rows without an id.
    """
    v = F.col(vector)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(v.isNotNull() & (F.size(v) > 0) & whole & F.col(key).isNotNull())
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, matrix) of (row, vec_id, v): at most `size` vectors of one length each time."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def whole(dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(c) for c in zip(*held.pop(dims), strict=True))

    for batch in batches:
        row, vec_id = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        offsets, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        lengths = np.diff(offsets)
        for dims in np.unique(lengths):
            at = np.flatnonzero(lengths == dims)
            while len(at):
                parts = held.setdefault(int(dims), [])
                part, at = at[: size - sum(len(x[0]) for x in parts)], at[size - sum(len(x[0]) for x in parts) :]
                parts.append((row[part], vec_id[part], values[offsets[part][:, None] + np.arange(dims)]))
                if sum(len(x[0]) for x in parts) >= size:
                    yield whole(int(dims))
    for dims in list(held):
        yield whole(dims)


def cells_of(data: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, cells): component j of a vector lies in [low + width * cell, low + width * (cell + 1)). Widths are whole numbers, 1 where nothing is lost."""
    low, high = data.min(axis=0), data.max(axis=0)
    span = high.astype(object) - low.astype(object)  # may exceed 64 bits
    width = np.array([max(1, -(-(int(s) + 1) // (1 << bits))) for s in span], dtype=np.uint64)
    return low, width, ((data.view(np.uint64) - low.view(np.uint64)) // width).astype(np.uint8)


def bounds(query: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries x vectors) lower and upper bounds of all scores, the rounding of floats allowed for."""
    q, step = query.astype(np.float64), width.astype(np.float64)
    middle = low.astype(np.float64) + (step - 1) / 2
    guess = (q * step) @ cells.T.astype(np.float64) + (q @ middle)[:, None]
    size = np.abs(q) @ (np.abs(low.astype(np.float64)) + step * (1 << BITS))
    spread = np.abs(q) @ ((step - 1) / 2) + 4 * len(step) * np.finfo(float).eps * size
    return guess - spread[:, None], guess + spread[:, None]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices; beyond 64 bits they count as the least or the greatest long."""
    if (np.abs(a.astype(np.float64)) * np.abs(b.astype(np.float64))).sum(axis=1).max(initial=0) < 2.0**62:
        return (a * b).sum(axis=1)
    return np.array([min(HIGH, max(LOW, int(x))) for x in (a.astype(object) * b.astype(object)).sum(axis=1)], dtype=np.int64)


class Scan:
    """The k best lower bounds of each query so far, and the vectors that may still be among the k best."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int):
        self.rows, self.ids, self.query, self.k = rows, ids, query, k
        self.lower = np.full((len(rows), k), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def meet(self, low: np.ndarray, width: np.ndarray, cells: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(self.rows), SLICE):
            part = slice(at, at + SLICE)
            lower, upper = (np.clip(x, LOW, HIGH) for x in bounds(self.query[part], low, width, cells))
            own = self.ids[part, None] == ids[None, :]
            lower[own] = upper[own] = -np.inf
            best = np.concatenate([self.lower[part], lower], axis=1)
            self.lower[part] = np.partition(best, best.shape[1] - self.k, axis=1)[:, -self.k :]
            i, j = np.nonzero((upper >= self.lower[part].min(axis=1)[:, None]) & ~own)
            self.found.append((at + i, rows[j], upper[i, j]))
            self.held += len(i)
        if self.held > 8 * self.k * len(self.rows):
            self.prune()

    def prune(self) -> None:
        i, rows, upper = (np.concatenate(c) for c in zip(*self.found, strict=True))
        kept = upper >= self.lower.min(axis=1)[i]
        self.found, self.held = [(i[kept], rows[kept], upper[kept])], int(kept.sum())

    def results(self) -> pa.RecordBatch:
        self.prune()
        i, rows, upper = self.found[0]
        order = np.argsort(i, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(self.rows)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order])) for x in (rows, upper)]
        lower = pa.ListArray.from_arrays(pa.array(np.arange(0, self.lower.size + 1, self.k, dtype=np.int32)), pa.array(self.lower.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(self.rows), lower, *lists], names=["q_row", "lower", "rows", "upper"])


def exact_topk(vectors: DataFrame, is_query: str, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) for every vector that fulfils `is_query`, against all others.

    `vectors` comes from integer_vectors. Only vectors of one length are compared. Rows that repeat an id
    are each a candidate of other ids, and each a query with ranks of its own; vectors with a query's own id never are its candidates. Fewer than k candidates:
    all of them. Ties go to the smaller vec_id. Scores beyond 64 bits count as the least or the greatest long. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors.withColumn("row", F.monotonically_increasing_id()))  # written once, so each row keeps its number
    n, m = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.expr(is_query), 1))).first()
    width, parts = shuffle_width(spark), max(1, -(-n // block))
    groups = max(1, -(-parts // group))
    query_block = min(query_block, max(SLICE, -(-m * groups // (2 * width))))  # two pairs of a block and a group for each task
    q_parts = max(1, -(-m // query_block))
    shape = "kind int, dims int, place long, blob_rows binary, blob_ids binary, low binary, width binary, data binary"
    names = [f.split()[0] for f in shape.split(", ")]

    def build(batches: Iterator[pa.RecordBatch], kind: int, size: int) -> Iterator[pa.RecordBatch]:
        for row, ids, data in _matrices(batches, size):
            low, step, packed = cells_of(data) if kind else (np.empty(0, np.int64), np.empty(0, np.uint64), data)
            values = (kind, data.shape[1], int(row[0]), *(x.tobytes() for x in (row, ids, low, step, packed)))
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    packed = lambda rows, number, kind, size: rows.select("row", "vec_id", "v").repartition(min(number, width)).mapInArrow(lambda x: build(x, kind, size), shape)
    cells = stored(packed(vectors, parts, 1, block))
    asked = stored(packed(vectors.filter(is_query), q_parts, 0, query_block))
    places = sorted(r["place"] for r in asked.select("place").collect())  # a number for each block of queries
    every = F.from_json(F.lit(str(places)), "array<bigint>")
    dealt = cells.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("int")).withColumn("q", F.explode(every))
    dealt = dealt.unionByName(asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("q", F.col("place")))
    dealt = dealt.repartition(max(width, min(len(places) * groups, 8 * width)), "q", "group").sortWithinPartitions("q", "group", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In front of the cell blocks of each (q, group) comes the block of queries."""
        state, dims = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                ids, rows = np.frombuffer(row["blob_ids"], np.int64), np.frombuffer(row["blob_rows"], np.int64)
                if row["kind"] == 0:
                    if state and state.found:
                        yield state.results()
                    dims = row["dims"]
                    state = Scan(rows, ids, np.frombuffer(row["data"], np.int64).reshape(-1, dims), k)
                elif row["dims"] == dims:
                    state.meet(np.frombuffer(row["low"], np.int64), np.frombuffer(row["width"], np.uint64), np.frombuffer(row["data"], np.uint8).reshape(-1, dims), rows, ids)
        if state and state.found:
            yield state.results()

    met = stored(dealt.mapInArrow(scan, "q_row long, lower array<double>, rows array<long>, upper array<double>"))
    bounds_ = met.select("q_row", F.explode("lower").alias("bar")).withColumn("place", F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("bar"))))
    bar = bounds_.filter(F.col("place") <= k).filter(F.col("place") == k).select("q_row", "bar")  # each task sends k of a query
    candidates = met.select("q_row", F.inline(F.arrays_zip("rows", "upper"))).join(bar, "q_row").filter("upper >= bar").select("q_row", F.col("rows").alias("row"), "upper")
    candidates = stored(candidates)
    best_first = Window.partitionBy("q_row").orderBy(F.desc("upper"), "row")
    place = candidates.withColumn("place", F.row_number().over(best_first))
    first = stored(_exact(place.filter(F.col("place") <= k).select("q_row", "row"), vectors, candidates))
    certain = first.groupBy("q_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(LOW)).alias("kth"))
    rest = place.filter(F.col("place") > k).join(certain, "q_row").filter(F.col("upper") >= F.col("kth").cast("double") - 1 - F.abs(F.col("kth").cast("double")) * 1e-12).select("q_row", "row")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = first.unionByName(_exact(rest, vectors, candidates)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _exact(pairs: DataFrame, vectors: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q_row, query_id, row, vec_id, score) of each (q_row, row), which are some of the stored candidates."""
    asked = vectors.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    both = spread_join(pairs, vectors, "row", ["q_row"], candidates).join(asked, "q_row").select("q_row", "query_id", "row", "vec_id", "q", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(4).offsets.to_numpy()
            q, v = batch.column(4).flatten().to_numpy(), batch.column(5).flatten().to_numpy()
            lengths, out = np.diff(offsets), np.zeros(batch.num_rows, dtype=np.int64)
            start = offsets[:-1] - offsets[0]
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                cells = start[at][:, None] + np.arange(dims)
                out[at] = scores(q[cells], v[cells])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], names=["q_row", "query_id", "row", "vec_id", "score"])

    return both.mapInArrow(run, "q_row long, query_id long, row long, vec_id long, score long")
