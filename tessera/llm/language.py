"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a GRU over windows of `span` bytes, with x / (1 + |x|) in place of tanh and its rescaled form in place of the
logistic gate, which numpy computes without exponentials. Both states of a byte give the language
probabilities of that byte; a document's are their mean over all its bytes. The network is trained on the driver by
backpropagation through time (Adam, cross-entropy at every byte) on a bounded sample of labelled rows: `per_language` documents
of each language and `train_windows` windows of them. Prediction runs where the texts lie, window by window, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ranked_sample

HIDDEN, SPAN, LANES = 12, 64, 2048
PER_LANGUAGE, TRAIN_WINDOWS, STEPS, BATCH, RATE = 200, 16000, 300, 192, 0.02


@dataclass
class Gru:
    """x: (3 hidden, 256) input weights of each byte (update, reset, candidate); u: (2 hidden, hidden); v: (hidden, hidden)."""

    x: np.ndarray
    u: np.ndarray
    v: np.ndarray


@dataclass
class Model:
    languages: list[str]
    forward: Gru
    backward: Gru
    out: np.ndarray  # (languages, 2 hidden)
    bias: np.ndarray


def _step(p: Gru, h: np.ndarray, gx: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(h)
    a = p.u @ h
    a += gx[: 2 * n]
    a /= 1 + np.abs(a)
    gates = a * np.float32(0.5)
    gates += np.float32(0.5)
    c = p.v @ (gates[n:] * h)
    c += gx[2 * n :]
    c /= 1 + np.abs(c)
    new = c - h
    new *= gates[:n]
    new += h
    return new, a, gates, c


def run_gru(p: Gru, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (steps, hidden, lanes) over data (steps, lanes)."""
    h = np.zeros((p.u.shape[1], data.shape[1]), dtype=np.float32)
    states, trace = np.empty((len(data), *h.shape), dtype=np.float32), []
    for t, row in enumerate(data):
        new, a, gates, c = _step(p, h, np.take(p.x, row, axis=1))
        if keep:
            trace.append((h, a, gates, c))
        states[t] = h = new
    return states, trace


def probabilities(m: Model, data: np.ndarray) -> np.ndarray:
    """(steps, languages, lanes): the label probabilities of every byte."""
    f, _ = run_gru(m.forward, data)
    b, _ = run_gru(m.backward, data[::-1])
    n = f.shape[1]
    logits = np.matmul(m.out[:, :n], f) + np.matmul(m.out[:, n:], b[::-1]) + m.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _back(p: Gru, data: np.ndarray, trace: list, dstates: np.ndarray) -> Gru:
    """Gradients of the parameters, through all steps."""
    n = p.u.shape[1]
    du, dv, dx, dh = np.zeros_like(p.u), np.zeros_like(p.v), np.empty((len(data), 3 * n, data.shape[1]), np.float32), np.zeros_like(dstates[0])
    for t in range(len(data) - 1, -1, -1):
        h, a, gates, c = trace[t]
        dh = dh + dstates[t]
        z, r = gates[:n], gates[n:]
        dc = dh * z * (1 - np.abs(c)) ** 2
        dv += dc @ (r * h).T
        drh = p.v.T @ dc
        da = np.concatenate([dh * (c - h), drh * h]) * np.float32(0.5) * (1 - np.abs(a)) ** 2
        du += da @ h.T
        dx[t, : 2 * n], dx[t, 2 * n :] = da, dc
        dh = dh * (1 - z) + drh * r + p.u.T @ da
    flat, codes = dx.transpose(1, 0, 2).reshape(3 * n, -1), data.ravel()
    return Gru(np.stack([np.bincount(codes, weights=row, minlength=256) for row in flat]).astype(np.float32), du, dv)


def windows(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x span bytes, owner of each, bytes in each); empty texts have none."""
    counts = np.array([-(-len(t) // span) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(t.ljust(int(n) * span, b"\0") for t, n in zip(texts, counts, strict=True)), np.uint8).reshape(-1, span)
    sizes = np.full(len(data), span)
    ends = np.cumsum(counts)
    filled = counts > 0
    sizes[ends[filled] - 1] = np.array([len(t) for t in texts], dtype=np.int64)[filled] - (counts[filled] - 1) * span
    return data, np.repeat(np.arange(len(texts)), counts), sizes


def train(samples: list[tuple[str, str]], hidden: int = HIDDEN, span: int = SPAN, train_windows: int = TRAIN_WINDOWS, steps: int = STEPS, batch: int = BATCH, seed: int = 1) -> Model | None:
    """Fit on (text, language) samples; None without any."""
    samples = sorted((t, lang) for t, lang in samples if t)
    if not samples:
        return None
    rng, languages = np.random.default_rng(seed), sorted({lang for _, lang in samples})
    data, owner, sizes = windows([t.encode("utf-8", "surrogatepass") for t, _ in samples], span)
    label = np.array([languages.index(lang) for _, lang in samples])[owner]
    each = max(1, train_windows // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == i))[:each] for i in range(len(languages))])
    data, label, sizes = data[chosen], label[chosen], sizes[chosen]
    pools = [np.flatnonzero(label == i) for i in range(len(languages))]

    def fresh() -> Gru:
        scale = 1 / np.sqrt(hidden)
        return Gru(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (3 * hidden, 256)), (scale, (2 * hidden, hidden)), (scale, (hidden, hidden)))))

    m = Model(languages, fresh(), fresh(), rng.normal(0, 0.1, (len(languages), 2 * hidden)).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [m.forward.x, m.forward.u, m.forward.v, m.backward.x, m.backward.u, m.backward.v, m.out, m.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(pool, -(-batch // len(languages))) for pool in pools])
        x, y = np.ascontiguousarray(data[pick].T), label[pick]
        inside = (np.arange(span)[:, None] < sizes[pick]).astype(np.float32)
        f, ftrace = run_gru(m.forward, x, keep=True)
        b, btrace = run_gru(m.backward, x[::-1], keep=True)
        b = b[::-1]
        logits = np.matmul(m.out[:, :hidden], f) + np.matmul(m.out[:, hidden:], b) + m.bias[:, None]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(len(y))] -= 1
        p *= (inside / inside.sum())[:, None, :]
        df, db = np.matmul(m.out[:, :hidden].T, p), np.matmul(m.out[:, hidden:].T, p)
        dout = np.concatenate([np.einsum("tlb,thb->lh", p, f, optimize=True), np.einsum("tlb,thb->lh", p, b, optimize=True)], axis=1)
        gf, gb = _back(m.forward, x, ftrace, df), _back(m.backward, x[::-1], btrace, db[::-1])
        gradients = [gf.x, gf.u, gf.v, gb.x, gb.u, gb.v, dout, p.sum(axis=(0, 2))]
        norm = np.sqrt(sum(float((g**2).sum()) for g in gradients))
        rate = RATE * (1 - step / (steps + 1))
        for w, g, a, s in zip(params, gradients, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            s += 0.01 * (g * g - s)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return m


def labelled_sample(rows: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most `per_language` distinct (text, lang) of each language, those whose texts hash lowest; rows without text or language don't count."""
    return ranked_sample(rows.filter("text is not null and text <> '' and lang is not null"), "lang", "text", per_language)


def predict(m: Model | None, texts: list[str | None], span: int = SPAN, lanes: int = LANES) -> list[tuple[str, float]]:
    """(language, probability) of each whole text; ('und', 0) if it is null or has no letter."""
    speaks = [m is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
    raw = [t.encode("utf-8", "surrogatepass") if s else b"" for t, s in zip(texts, speaks, strict=True)]
    pooled = np.zeros((len(texts), len(m.languages) if m else 1))
    data, owner, sizes = windows(raw, span)
    for at in range(0, len(data), lanes):
        p = probabilities(m, np.ascontiguousarray(data[at : at + lanes].T))
        size = sizes[at : at + lanes]
        for i in np.flatnonzero(size < span):
            p[size[i] :, :, i] = 0
        total = p.sum(axis=0)
        for j in range(len(m.languages)):
            pooled[:, j] += np.bincount(owner[at : at + lanes], weights=total[j], minlength=len(texts))
    best = pooled.argmax(axis=1)
    return [(m.languages[b], float(min(1.0, row[b] / len(r)))) if s else ("und", 0.0) for b, row, r, s in zip(best, pooled, raw, speaks, strict=True)]


def identify(docs: DataFrame, m: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1), or what `names` calls them. Null texts and texts without a letter are 'und', score 0.

    Rows are predicted one by one, so equal texts get equal results. Texts are read whole, however long. Other columns pass through; columns
    of the two names are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*names)
    at = docs.columns.index(text)
    new, names = names, [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, first, size = batch.column(at).to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 4 << 20:
                    found += predict(m, texts[first : i + 1])
                    first, size = i + 1, 0
            found += predict(m, texts[first:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{new[0]}` string, `{new[1]}` double")


def remainder(key: str, divisor: int):
    """crc32 of the key as text, modulo `divisor`; null keys have none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def identify_held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on the rows with a language whose crc32(doc_id) mod 4 is not 2; a null doc_id is neither."""
    m = train(labelled_sample(docs.filter(remainder("doc_id", 4) != 2)))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), m).select("doc_id", held.alias("held_out"), "lang_pred", "score")
