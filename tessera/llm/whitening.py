"""Embedding whitening: leading principal components by matrix-free block subspace iteration.

The covariance is never formed. It is met only as an operator: a pass of Spark over the stored fit list gives Xᵀ(XQ) for a block Q
of at most BLOCK directions, X being the centred vectors. The driver keeps the subspace that the blocks span (at most
KEEP blocks of directions, each as long as a vector) and what the operator made of it; after each pass it takes the Ritz pairs of the
whole subspace. Their residuals certify them: for a symmetric operator an eigenvalue lies within |Vu - eu| of e, and u
within |Vu - eu| / gap of its eigenvector. Until all k residuals are at rounding error the next block is the QR factor of the
residuals of the leading pairs. A full subspace shrinks to its leading Ritz vectors, which costs no pass.

What grows with the data stays in Spark: the distinct vectors (one shuffle of packed integers, combined before it), exact sums, and each pass,
whose tasks hold one batch and one dims x BLOCK matrix and whose matrices are summed by row of the matrix.

Whole numbers: an entry c counts as x = floor(64 * c) + 1000000, with floor(64 * c) held within ±2^61. Vectors are centred at the whole number next to the mean, without error, and
then by the rest, which is below one; so nothing cancels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import forget, free_names, stored

SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 61
#: Directions in a block, blocks in the subspace before it shrinks, passes at most.
BLOCK, KEEP, PASSES = 32, 8, 300
#: Residuals up to this part of the largest eigenvalue are rounding error; components below SMALLEST of it aren't told from zero.
CERTAIN, SMALLEST = 1e-14, 1e-12
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """n vectors with exact sums, their leading eigenvectors (columns), eigenvalues, the trace, and how far whitened vectors' covariance is from the identity.

    `residuals` has the certificate of each component, `passes` how often the fit list was read for them.
    """

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray
    passes: int


def _whole(vector: str):
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))


def _integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """x vectors of a list column; shorter ones end in zeros, as c = 0."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths, out = np.diff(at), np.full((len(column), dims), SHIFT, dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = _integers(flat[at[0] : at[-1]])
    return out


def _packed(x: np.ndarray) -> list[bytes]:
    """One value per vector, equal if and only if the vectors are: entries less SHIFT, in as few bytes as the largest of a vector needs."""
    x = x - SHIFT
    size = np.abs(x).max(axis=1, initial=0)
    width = np.where(size < 1 << 7, 1, np.where(size < 1 << 15, 2, np.where(size < 1 << 31, 4, 8)))
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width):
        for i, row in zip(at := np.flatnonzero(width == w), x[at].astype(f"<i{w}"), strict=True):
            out[i] = row.tobytes()
    return out


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of `_packed`, still less SHIFT."""
    out = np.empty((len(column), dims), dtype=np.int64)
    for i, b in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(b, dtype=f"<i{len(b) // dims}")
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def fit_list(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """(x binary): each distinct x vector once, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_packed(_matrix(batch.column(0), dims)), pa.binary())], ["x"])

    return rows.select(F.col(vector)).mapInArrow(pack, "x binary").distinct()


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension; each task sends one row per dimension, the high and low halves apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dims, np.int64), np.zeros(dims, np.int64), 0
        for batch in _chunks(batches):
            x = _unpacked(batch.column(0), dims)
            high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(high), pa.array(low), pa.array(np.full(dims, n))], ["i", "high", "low", "n"])

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    found = sorted(fit.mapInArrow(add, "i long, high long, low long, n long").groupBy("i").agg(*exact).collect(), key=lambda r: r["i"])
    return (int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]) if found else (0, [])


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(whole, rest): the mean is whole + rest, rest within half."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])


def applied(fit: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(VQ, trace's parts): the covariance V of the fit list times the block q, by one pass, and the variance of each dimension."""
    dims, width = q.shape
    whole, rest = _centre(n, sums)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, any_ = np.zeros((dims, width)), np.zeros(dims), False
        for batch in _chunks(batches):
            x = (_unpacked(batch.column(0), dims) - whole).astype(np.float64) - rest
            total += x.T @ (x @ q)
            squares += (x * x).sum(axis=0)
            any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(squares), *[pa.array(total[:, j]) for j in range(width)]], ["i", "s", *[f"y{j}" for j in range(width)]])

    columns = ["s", *[f"y{j}" for j in range(width)]]
    done = fit.mapInArrow(multiply, "i long, " + ", ".join(f"{c} double" for c in columns)).groupBy("i").agg(*[F.sum(c).alias(c) for c in columns])
    found = np.array([[r[c] for c in columns] for r in sorted(done.collect(), key=lambda r: r["i"])]) / n
    return found[:, 1:], found[:, 0]


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `block` has outside of the orthonormal columns `against`."""
    for _ in range(3):  # what rounding leaves of the first round is gone after the next
        block, _ = np.linalg.qr(block - against @ (against.T @ block))
    return block


def subspace(dims: int, k: int, apply, block: int = BLOCK, keep: int = KEEP, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(vectors, values, residual norms, passes) of the k leading eigenpairs of the symmetric operator `apply`: (dims x width) -> (dims x width)."""
    rng = np.random.default_rng(11)
    block = min(dims, max(block, k + 8))
    k, room = min(k, dims), min(dims, max(2, keep) * block)
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    new, best, stale = rng.standard_normal((dims, block)), np.inf, 0
    for done in range(1, passes + 1):
        if basis.shape[1] + new.shape[1] > room and room < dims:  # shrink to the leading Ritz vectors
            basis, image = basis @ ritz[:, : 2 * block], image @ ritz[:, : 2 * block]
        new = _orthonormal(new[:, : dims - basis.shape[1]], basis)
        basis, image = np.hstack([basis, new]), np.hstack([image, apply(new)])
        small = basis.T @ image
        values, ritz = np.linalg.eigh((small + small.T) / 2)
        values, ritz = values[::-1], ritz[:, ::-1]
        vectors = basis @ ritz
        left = image @ ritz[:, :block] - vectors[:, :block] * values[:block]
        residuals = np.linalg.norm(left, axis=0)[:k]
        worst, scale = residuals.max(initial=0.0), max(float(np.abs(values).max(initial=0.0)), 1e-300)
        best, stale = (worst, 0) if worst < best / 2 else (best, stale + 1)
        if worst <= CERTAIN * scale or basis.shape[1] == dims or (stale >= 3 and worst <= 100 * CERTAIN * scale):
            break
        # Directions that are certain already have rounding error alone for a residual: fresh random ones take their places.
        norms = np.linalg.norm(left, axis=0)
        new = np.where(norms > CERTAIN * scale, left / np.maximum(norms, 1e-300), rng.standard_normal(left.shape))
    else:
        raise RuntimeError(f"after {passes} passes a residual is {worst / scale:.3g} of the largest eigenvalue")
    vectors, r = np.linalg.qr(vectors[:, :k])
    return vectors * np.where(np.diag(r) < 0, -1.0, 1.0), values[:k], residuals, done


def fit_whitening(rows: DataFrame, vector: str = "embedding", k: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors among `rows`, or None where there is no vector with an entry.

    Rows whose vector is null or holds null, NaN or infinite entries take no part; shorter vectors count as if zeros followed. Components whose eigenvalue is
    zero (fewer distinct vectors than k, or dimensions that depend on others) are left out, as nothing can be divided by it; so one distinct vector has none.
    """
    kept = rows.filter(_whole(vector)).select(vector)
    dims = kept.agg(F.max(F.size(vector))).first()[0] or 0
    if not dims:
        return None
    fit = stored(fit_list(kept, vector, dims))
    n, sums = _sums(fit, dims)
    parts: list[np.ndarray] = []

    def apply(q: np.ndarray) -> np.ndarray:
        y, squares = applied(fit, n, sums, q)
        parts.append(squares)
        return y

    vectors, values, residuals, passes = subspace(dims, k, apply)
    use = values > SMALLEST * max(values.max(initial=0.0), 1e-300)
    vectors, values, residuals = vectors[:, use], values[use], residuals[use]
    error = 0.0
    if len(values):
        w = vectors / np.sqrt(values)
        error = float(np.abs(w.T @ applied(fit, n, sums, w)[0] - np.eye(len(values))).max())
    forget(fit)
    return Whitening(n, tuple(s + n * SHIFT for s in sums), vectors, values, float(parts[0].sum()), error, residuals, passes)


def whiten(rows: DataFrame, model: Whitening | None, vector: str = "embedding", names: tuple[str, str] = ("whitened", "deviation")) -> DataFrame:
    """`rows` that take part, with `names`: the whitened vector (array<double>, one entry per component) and deviation (long), the sum over dimensions of (n * x - S)^2.

    The deviation is exact; one beyond 64 bits is null. All columns stay; the new ones must have names of their own (`common.free_names`). Repeated rows and ids fare alike.
    """
    added, deviation = names
    kept = rows.filter(_whole(vector))
    if model is None:
        return kept.limit(0).withColumn(added, F.array().cast("array<double>")).withColumn(deviation, F.lit(None).cast("long"))
    n, sums = model.n, [s - model.n * SHIFT for s in model.sums]
    whole, rest = _centre(n, sums)
    excess = [s - n * int(w) for s, w in zip(sums, whole, strict=True)]
    w, at, dims, header = model.vectors / np.sqrt(model.values), kept.columns.index(vector), len(sums), [*kept.columns, added, deviation]

    def deviations(x: np.ndarray) -> list[int | None]:
        guess = ((x.astype(np.float64) * n - np.array(excess, dtype=np.float64)) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            exact = ((x * np.int64(n) - np.array(excess, dtype=np.int64)) ** 2).sum(axis=1)  # right where the sum is far below 2^63
        out: list[int | None] = exact.tolist()
        for i in np.flatnonzero(guess > 2.0**62):
            total = sum((n * int(c) - e) ** 2 for c, e in zip(x[i], excess, strict=True)) if guess[i] < 2.0**64 else 1 << 63
            out[i] = total if total < 1 << 63 else None
        return out

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            x = _matrix(batch.column(at), dims) - SHIFT - whole
            y = (x.astype(np.float64) - rest) @ w
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(deviations(x), pa.int64())], header)

    schema = T.StructType([*kept.schema.fields, T.StructField(added, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.LongType())])
    return kept.mapInArrow(project, schema)


def whitened_components(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per row that takes part and component.

    Rows with null ids and repeated ones are rows like any others; further columns are not read. An empty table, or one without two distinct vectors, gives no rows.
    """
    slim = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))
    model = fit_whitening(slim, "v", k)
    y, d = free_names(slim, "whitened", "deviation")
    out = whiten(slim, model, "v", (y, d)).select("vec_id", F.col(d).alias("deviation"), F.posexplode(y).alias("i", "whitened"))
    shares = [float(e) / model.trace for e in model.values] if model is not None else []
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("i") + 1) if shares else F.lit(None).cast("double")
    n, error = (model.n, model.identity_error) if model is not None else (0, 0.0)
    return out.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )
