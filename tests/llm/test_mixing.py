import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, registry
from tessera.sources.tables import table

from .helpers import DOCS, FOLDER, documents, prose, tricky

LABELS = "doc_id long, quality int, toxic int"


def test_rates_meet_targets(spark):
    rows = [(i, 10 + i % 7, [0.8, 0.2] if i % 4 else [0.1, 0.9]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    total = sum(r[1] for r in rows)
    out = mixing.fit_rates(df, [0.5 * total, 0.7 * total]).collect()
    got = [sum(r["rate"] * r["tokens"] * r["p"][j] for r in out) for j in (0, 1)]
    assert got == pytest.approx([0.5 * total, 0.7 * total], rel=0.01)
    assert min(r["rate"] for r in out) >= 0
    # A target that no nonnegative rates reach: rates stay at zero or above.
    assert min(r["rate"] for r in mixing.fit_rates(df, [1.2 * total, 0.001 * total]).collect()) >= 0


def test_query_meets_targets(spark):
    rows = registry.op2_mixing(spark, FOLDER).collect()
    assert len(rows) == table(spark, FOLDER, "documents").count()
    budget = mixing.BUDGET * sum(r["tokens"] for r in rows)
    for domain, share in mixing.TARGETS.items():
        assert sum(r["rate"] * r["tokens"] * r[f"p_{domain}"] for r in rows) / budget == pytest.approx(share, rel=0.02)
        assert all(abs(r["p_good"] + r["p_poor"] + r["p_toxic"] - 1) < 1e-9 for r in rows)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)


def test_classifier_separates(spark):
    docs = documents(spark, [prose("a", 3) + " nice fine" if i % 2 else prose("b", 3) + " junk bad" for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS)
    out = mixing.mix(docs, labels, {"good": 0.5, "poor": 0.5}).collect()
    assert all((r["p"][0] > 0.5) == bool(r["doc_id"] % 2) for r in out)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1), (5, 0, 0), (5, 1, 1), (None, 1, 0)], LABELS)
    out = mixing.mix(tricky(spark), labels).collect()
    assert len(out) == 9 and all(abs(sum(r["p"]) - 1) < 1e-9 and r["rate"] >= 0 for r in out)
    same = [r for r in out if r["doc_id"] == 4]
    assert same[0] == same[1]
    assert {r["tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty, labels).count() == 0
    assert mixing.mix(tricky(spark), spark.createDataFrame([], LABELS)).count() == 9
    copies = {(r["doc_id"], r["text_hash"]): r["copies"] for r in out}
    taken = mixing.mixed_documents(tricky(spark), labels)
    assert taken.columns == tricky(spark).columns
    want = sum(c * (2 if k[0] == 4 else 1) for k, c in copies.items())
    assert taken.count() == want
    assert mixing.domains_of(labels).filter(F.col("doc_id") == 5).first()["domain"] == "toxic"


def test_rates_meet_the_least_squares_solution(spark):
    """Against a dense solver: projected gradient in numpy, run to the end; the fitted rates lose no more than the tolerance allows."""
    import numpy as np

    rng = np.random.default_rng(1)
    p, tokens = rng.dirichlet([0.4, 0.4, 0.4], 60), rng.integers(5, 300, 60)
    targets = np.array([0.6, 0.3, 0.1]) * tokens.sum()
    rows = spark.createDataFrame([(i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, p array<double>")
    got = {r["doc_id"]: r["rate"] for r in mixing.fit_rates(rows, targets.tolist()).collect()}
    rate = np.array([got[i] for i in range(60)])
    a = (p * tokens[:, None]).T / targets[:, None]
    best = np.ones(60)
    for _ in range(20000):
        best = np.maximum(0, best - a.T @ (a @ best - 1) / np.linalg.norm(a, 2) ** 2)
    assert (rate >= 0).all() and np.abs(a @ rate - 1).max() <= np.abs(a @ best - 1).max() + mixing.TOLERANCE
