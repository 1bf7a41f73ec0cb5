import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import registry, whitening

from .helpers import FOLDER


def brute(rows, k=16):
    """By a dense eigensolver over vectors padded with zeros; deviations in Python's own whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    if not dims:
        return [], None
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for _, v in kept]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], dtype=float) / n
    values, vectors = np.linalg.eigh(exact.T @ exact / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    use = [j for j in range(min(k, dims)) if values[j] > 1e-12 * max(values[0], 1e-300)]
    out = []
    for (i, _), v in zip(kept, x, strict=True):
        whole = [n * a - s for a, s in zip(v, sums, strict=True)]
        deviation = sum(d * d for d in whole)
        z = np.array(whole, dtype=float) / n
        out += [(i, j + 1, n, deviation if deviation < 1 << 63 else None, float(z @ vectors[:, j] / np.sqrt(values[j])), float(values[j] / values.sum())) for j in use]
    return out, values


def compare(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4]))
    got, want = sorted([tuple(r) for r in got], key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for j in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in x if r[1] == j]) for x in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6 * max(1, np.abs(b).max())
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert all(r[6] < 1e-9 for r in got)


def test_query_matches_a_dense_solver(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet'").fetchall()
    got = registry.op11_whitening(spark, FOLDER).collect()
    want, values = brute(rows)
    assert len(got) == 16 * len(rows) and (values[:15] / values[1:16]).min() > 1
    compare(got, want)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 400), st.integers(1, 20), st.sampled_from(["steep", "flat", "ties", "low rank"]), st.integers(0, 10**6))
def test_subspace_finds_leading_pairs(dims, k, kind, seed):
    rng = np.random.default_rng(seed)
    spectrum = {"steep": 2.0 ** -np.arange(dims), "flat": 1 + 0.5 / (1 + np.arange(dims)), "ties": np.floor(8 - np.arange(dims) / 5).clip(1), "low rank": (np.arange(dims) < 5).astype(float)}[kind]
    q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    v = (q * spectrum) @ q.T
    vectors, values, residuals, passes = whitening.subspace(dims, k, lambda b: v @ b)
    k = min(k, dims)
    assert values == pytest.approx(np.sort(spectrum)[::-1][:k], abs=1e-12 * spectrum.max())
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13 and np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * spectrum.max()
    assert residuals.max() <= 1e-12 * spectrum.max() and (passes <= 2 or dims > 64)


def test_more_dimensions_than_the_subspace_holds(spark):
    """The subspace shrinks and grows again, and the fit list is read in each pass."""
    rng = np.random.default_rng(5)
    data = rng.standard_normal((600, 150)) * (1 + 3 / (1 + np.arange(150)))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    fit = whitening.fit_list(spark.createDataFrame(rows, "vec_id int, v array<double>"), "v", 150)
    n, sums = whitening._sums(fit, 150)
    vectors, values, residuals, passes = whitening.subspace(150, 4, lambda q: whitening.applied(fit, n, sums, q)[0], block=12, keep=3)
    x = np.floor(64 * data)
    dense = np.linalg.eigh(np.cov(x.T, bias=True))
    assert passes > 3 and values == pytest.approx(dense[0][::-1][:4], rel=1e-12)
    assert np.abs(np.abs(vectors.T @ dense[1][:, ::-1][:, :4]) - np.eye(4)).max() < 1e-9


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e9, 1e30])
def test_edges(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (scale * v).tolist()) for i, v in enumerate(rng.standard_normal((30, 5)))]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (100, None), (101, [1.0, None]), (102, [float("nan")] * 5), (103, [1.0, float("inf")]), (104, []), (105, [scale])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", *[f"'x' as {c}" for c in ("component", "v", "n", "whitened", "deviation", "i", "x")])
    got = whitening.whitened_components(df).collect()
    if scale < 1e12:
        compare(got, brute(rows)[0])
    assert len(got) == 5 * 35 and all(np.isfinite(r["whitened"]) for r in got)
    one = whitening.whiten(df, whitening.fit_whitening(df), names=("white_", "dev_"))
    assert one.columns == [*df.columns, "white_", "dev_"] and one.count() == 35


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, []), (2, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0]), (3, [2.001])]):
        assert whitening.whitened_components(spark.createDataFrame(rows, schema)).collect() == []
    assert len(whitening.whitened_components(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 5.0])], schema)).collect()) == 2
