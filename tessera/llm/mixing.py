"""Mixing to target weights by soft membership. DataFrame functions only.

A naive Bayes classifier over hashed words, fitted on a bounded sample of labelled rows, gives each document a
posterior over domains. Nonnegative rates per document are then fitted by projected gradient: the expected tokens
of each domain, sum of rate x tokens x posterior, shall meet the domain's target. Residuals count relative to their
targets, steps are in the metric of tokens, so a document's step depends on its posteriors alone. Each iteration is one
aggregation to as many numbers as there are domains; only these reach the driver. Rates come from the list of residuals
so far, folded over in one expression, and are stored every few iterations to keep that list short. Step lengths follow Barzilai and Borwein.
"""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, stored

BINS, LABELLED, SHARPNESS, ITERATIONS, TOLERANCE, RIDGE, FOLD = 4096, 20000, 40.0, 80, 0.002, 1e-3, 16
#: Targets and budget (times the tokens there are) of the query and of the pipeline.
TARGETS, BUDGET = {"good": 0.85, "poor": 0.10, "toxic": 0.05}, 1.25


def _literal(values: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), lambda w: w != "")


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic flags: toxic, good or poor; rows without flags or id don't count.

    A document with several rows is toxic if any says so, else poor if any says so.
    """
    flags = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    return flags.select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "good").otherwise("poor").alias("domain"))


def fit_bayes(docs: DataFrame, domain_rows: DataFrame, domains: list[str], labelled: int = LABELLED, bins: int = BINS) -> tuple[list[float], list[list[float]]]:
    """(log priors, log likelihoods by domain and bin) from at most `labelled` rows of (doc_id, domain), chosen by a hash."""
    chosen = domain_rows.filter(F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `labelled` short rows
    words = known.select("domain", F.explode(_words(F.col("text"))).alias("word"))
    counts = words.groupBy("domain", F.pmod(F.hash("word"), F.lit(bins)).alias("bin")).count().collect()  # at most domains x bins
    sizes = {r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()}
    table = [[0.5] * bins for _ in domains]
    for r in counts:
        table[domains.index(r["domain"])][r["bin"]] += r["count"]
    total = sum(sizes.values()) + len(domains)
    priors = [math.log((sizes.get(d, 0) + 1) / total) for d in domains]
    return priors, [[round(math.log(n / sum(row)), 6) for n in row] for row in table]


def with_posteriors(rows: DataFrame, text: str, priors: list[float], likelihoods: list[list[float]], sharpness: float = SHARPNESS) -> DataFrame:
    """`rows` with tokens (words between white space) and p, array<double>: the mean word log likelihood counts as
    `sharpness` words, or as the words there are if fewer.

    Each step is a projection of its own, so that what several later ones use is computed once.
    """
    bins = F.transform(_words(F.col(text)), lambda w: F.pmod(F.hash(w), F.lit(len(likelihoods[0]))) + 1)
    rows = rows.withColumn("__bins", bins)
    base = likelihoods[0]
    for j, row in enumerate(likelihoods):
        ratio = _literal([round(x - y, 6) for x, y in zip(row, base, strict=True)], "array<double>")
        add = lambda r: lambda s, b: s + F.element_at(r, b)
        rows = rows.withColumn(f"__s{j}", F.aggregate("__bins", F.lit(0.0), add(ratio)) if j else F.lit(0.0))
    share = F.least(F.lit(sharpness) / F.greatest(F.size("__bins"), F.lit(1)), F.lit(1.0))
    rows = rows.withColumns({f"__x{j}": F.col(f"__s{j}") * share + prior for j, prior in enumerate(priors)})
    names = [f"__x{j}" for j in range(len(priors))]
    rows = rows.withColumn("__best", F.greatest(*names) if len(names) > 1 else F.col(names[0]))
    rows = rows.withColumns({f"__e{j}": F.exp(F.col(x) - F.col("__best")) for j, x in enumerate(names)})
    raised = [F.col(f"__e{j}") for j in range(len(names))]
    total = sum(raised[1:], raised[0])
    rows = rows.withColumn("tokens", F.size("__bins").cast("long")).withColumn("p", F.array(*[x / total for x in raised]))
    return rows.drop("__bins", "__best", *[f"__{k}{j}" for k in "sxe" for j in range(len(names))])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fit_rates(rows: DataFrame, targets: list[float], iterations: int = ITERATIONS, tolerance: float = TOLERANCE, ridge: float = RIDGE, fold: int = FOLD) -> DataFrame:
    """`rows` (tokens, p, ...) with rate >= 0. targets: expected tokens of each domain; a domain with target zero or without documents is pulled towards zero or left.

    An empty table, or one without tokens, gets rates of 1.
    """
    total, d = sum(targets), len(targets)
    scale = [max(t, total * 1e-6) for t in targets]
    at = [F.element_at("p", j + 1) for j in range(d)]
    cells = rows.agg(*[F.sum(F.col("tokens") * at[i] * at[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(d)]).first()
    rows = rows.withColumn("_r", F.lit(1.0))
    if not total or not any(cells):
        return rows.withColumnRenamed("_r", "rate")
    gram = [[cells[i * d + j] for j in range(d)] for i in range(d)]
    form = lambda x, y: sum(x[i] * gram[i][j] * y[j] for i in range(d) for j in range(d))
    shortest = 1 / (sum(gram[j][j] / scale[j] for j in range(d)) + ridge)
    history: list[dict] = []

    def rate() -> Column:
        if not history:
            return F.col("_r")
        return F.aggregate(
            _literal(history, "array<struct<s: double, e: array<double>>>"), F.col("_r"), lambda r, x: F.greatest(F.lit(0.0), r - x["s"] * (_dot(F.col("p"), x["e"]) + ridge * (r - 1)))
        )

    step, before = shortest, None
    for turn in range(iterations):
        got = rows.withColumn("_now", rate()).agg(*[F.sum(F.col("_now") * F.col("tokens") * at[j]).alias(f"s{j}") for j in range(d)]).first()
        residual = [float(f"{(got[j] - targets[j]) / scale[j]:.9g}") for j in range(d)]
        if max(map(abs, residual)) < tolerance:
            break
        if turn + 1 == iterations:
            warnings.warn(f"rates stop {max(map(abs, residual)):.3g} of a target away from it after {iterations} steps", stacklevel=2)
        if before is not None:  # Barzilai-Borwein: the step that the last change of the gradient asks for
            bend = -form(before, [x - y for x, y in zip(residual, before, strict=True)])
            step = min(max(shortest, step * form(before, before) / bend), 1000 * shortest) if bend > 0 else shortest
            step = float(f"{step:.9g}")
        before = residual
        history.append({"s": step, "e": residual})
        if len(history) == fold and turn + 1 < iterations:
            rows = stored(rows.withColumn("_r", rate()))
            history = []
    return rows.withColumn("rate", rate()).drop("_r")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """(doc_id, text_hash, tokens, p array<double> in the order of the sorted domains, rate, copies) of every row of `docs`.

    tokens: words between white space, none for a null text, whose posterior is the prior. copies: the rate rounded up or
    down by a hash of id and text, so that copies average to rates and equal rows fare alike. Without labels all posteriors are even.
    """
    targets = targets or TARGETS
    domains = sorted(targets)
    priors, likelihoods = fit_bayes(docs, domains_of(labels), domains)
    rows = with_posteriors(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("__text")), "__text", priors, likelihoods).drop("__text")
    rows = stored(rows)
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    weight = sum(targets.values())
    fitted = fit_rates(rows, [total * budget * targets[d] / weight for d in domains])
    draw = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text_hash"), F.lit(1 << 24)) / float(1 << 24)
    return fitted.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def mixed_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as its copies say, with all their columns, whatever their names."""
    id_, hash_, copies, copy = free_names(docs, "id_", "hash_", "copies_", "copy_")
    rates = mix(docs, labels, **options).filter("copies > 0").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("copies").alias(copies)).distinct()
    (text_hash,) = free_names([*docs.columns, *rates.columns], "text_hash_")
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    taken = keyed.join(rates, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_)))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
