from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import registry, topk

from .helpers import FOLDER


def test_query_matches_sql(spark):
    duckdb.sql(f"create or replace view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    got = sorted(map(tuple, registry.op3_topk(spark, FOLDER).collect()))
    assert got == sorted(duckdb.sql(registry.OP3_SQL).fetchall())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 8), st.integers(0, 10**6), st.sampled_from([1, 3, 64, 5000, 10**8, 2**61]))
def test_cells_bound_every_score(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    data = rng.integers(-spread, spread + 1, (n, dims))
    low, width, cells = topk.cells_of(data)
    lower, upper = topk.bounds(data[:5], low, width, cells)
    for i in range(min(5, n)):
        for j in range(n):
            score = sum(int(a) * int(b) for a, b in zip(data[i], data[j], strict=True))
            assert lower[i, j] <= score <= upper[i, j]


def brute(vectors, k, is_query):
    out = []
    for i, q in vectors:
        if is_query(i):
            every = sorted((-max(topk.LOW, min(topk.HIGH, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in vectors if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(every)]
    return sorted(out)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    for size in (10**8, 10**9, 2**62):  # products beyond 2^53, sums near 2^63, sums beyond
        vectors = [(i, [int(x) for x in rng.integers(-size, size, 12)]) for i in range(150)]
        vectors += [(200 + i, vectors[0][1]) for i in range(5)]
        df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
        got = sorted(tuple(r) for r in topk.exact_topk(df, "vec_id % 20 = 0", 7, block=32, query_block=3, group=2).collect())
        assert got == brute(vectors, 7, lambda i: i % 20 == 0)


def test_repeated_rows_are_dealt_by_place(spark):
    vectors = [(7, [1, 2])] * 300 + [(20, [3, 4]), (20, [3, 5])]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>").repartition(3)
    got = Counter(tuple(r) for r in topk.exact_topk(df, "vec_id % 20 = 0", 3, block=50, query_block=1).collect())
    assert got == Counter([(20, r, 7, s) for s in (11, 13) for r in (1, 2, 3)])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (20, [-1.0, 2.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank", "3 as block", "4 as row")
    got = sorted(tuple(r) for r in topk.exact_topk(topk.integer_vectors(df), "vec_id % 20 = 0", 2).collect())
    assert got == [(0, 1, 1, 64 * 64 + 32 * 32), (0, 2, 2, 64 * 64 + 32 * 32), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert topk.exact_topk(topk.integer_vectors(df.limit(0)), "vec_id % 20 = 0", 2).count() == 0
    alone = topk.integer_vectors(df.filter("vec_id = 20"))
    assert topk.exact_topk(alone, "vec_id % 20 = 0", 2).count() == 0


def test_many_blocks_agree(spark):
    vectors = topk.integer_vectors(spark.read.parquet(f"{FOLDER}/embeddings.parquet"))
    few = topk.exact_topk(vectors, "vec_id % 50 = 0", 5)
    many = topk.exact_topk(vectors, "vec_id % 50 = 0", 5, block=16, query_block=3)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_slices_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", 3)
    for module in (topk.spread_join.__globals__,):
        monkeypatch.setitem(module, "HOT_FLOOR", 20)
    rng = np.random.default_rng(9)
    vectors = [(i, [int(x) for x in rng.integers(-50, 50, 6)]) for i in range(200)] + [(501, [10_000] * 6), (502, [-10_000] * 6)]  # near to every query
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>").repartition(5)
    got = sorted(tuple(r) for r in topk.exact_topk(df, "vec_id % 5 = 0", 4, block=32, query_block=7, group=2).collect())
    assert got == brute(vectors, 4, lambda i: i % 5 == 0)


def test_a_block_of_queries_meets_cells_in_slices():
    rng = np.random.default_rng(2)
    data = rng.integers(-99, 99, (3000, 8))
    whole = topk.Scan(np.arange(2500), np.arange(2500), data[:2500], 5)
    parts = [topk.Scan(np.arange(a, a + 500), np.arange(a, a + 500), data[a : a + 500], 5) for a in range(0, 2500, 500)]
    for state in (whole, *parts):
        state.meet(*topk.cells_of(data), np.arange(3000), np.arange(3000))
    assert whole.results().to_pylist() == [r for p in parts for r in p.results().to_pylist()]
