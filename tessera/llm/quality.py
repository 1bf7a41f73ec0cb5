"""Quality rules: a log-likelihood ratio of hashed n-grams, beside counts that any text must meet.

Tokens are runs of letters, digits and underscores (all characters beyond ASCII count as letters) and runs of other characters but white space. Tokens and pairs of neighbours are hashed into BUCKETS
each, and counted twice: over all documents (the raw corpus) and over the trusted ones. Both counts make a multinomial, smoothed by PRIOR counts
spread as the raw corpus is. A text's score is the mean, over its tokens and pairs, of log(trusted / raw): length doesn't count, and no text is
sampled or drawn: one with a score of at least THRESHOLD is kept, in every run.

Counting sends one row per bucket and task; the driver gets 2 * BUCKETS counts however large the corpus is. Trusted texts are told by a join on
the id that deals hot ids to several tasks. Texts are taken whole, as arrays of bytes; hashes propose nothing in the base facts, where words and lines themselves are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, mix64, spread_join

#: Buckets for tokens and again for pairs; weight of the raw corpus in the trusted multinomial; the least score, in nats a token or pair.
BUCKETS, PRIOR, THRESHOLD = 1 << 15, 32768.0, -0.35
#: Base rules: words at least; words in repeated windows at most, in per cent.
LEAST_WORDS, MOST_REPEATED = 50, 50

SYMBOLS = "#*$%&|<>"
WORD, BLANK = re.compile(r"[^\x20\x09-\x0D]"), re.compile(rb"[\x20\x09-\x0D]")
#: Texts are worked on in slices of at most so many bytes, many short ones together. A longer text is cut after the last white space of a slice, or where the slice is full; no token or pair crosses a cut.
SLICE = 1 << 20

#: Class of a byte: 0 white space, 1 letters, digits, underscores and all beyond ASCII, 2 the rest.
CLASS = np.full(256, 2, dtype=np.uint8)
CLASS[list(b" \t\n\v\f\r")] = 0
CLASS[[*range(128, 256), *b"_", *range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1

_BASE = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    #: Powers of an odd number and of its inverse, so that the hash of a run of bytes is a difference of prefix sums.
    POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SLICE, _BASE, np.uint64)]), dtype=np.uint64)
    INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SLICE, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)


def slices(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (number of the text, slice of it), each of at most SLICE bytes together."""
    group, held = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(at + SLICE, len(text))
            if end < len(text):
                end = max((text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")), default=-1) + 1 or end
            if held + end - at > SLICE:
                yield group
                group, held = [], 0
            group.append((i, text[at:end]))
            held, at = held + end - at, end
    if group:
        yield group


def features(group: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of texts, buckets) of all tokens in a group of slices, then of all pairs of neighbours within a slice."""
    data = np.frombuffer(b"".join(s for _, s in group), np.uint8)
    ends = np.cumsum([len(s) for _, s in group])
    kind = CLASS[data]
    changes = np.empty(len(data), bool)
    changes[0], changes[1:] = True, kind[1:] != kind[:-1]
    changes[ends[:-1]] = True
    at = np.flatnonzero(changes)
    to = np.append(at[1:], len(data))
    token = kind[at] > 0
    at, to = at[token], to[token]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * POWERS[: len(data)], dtype=np.uint64)])
    hashed = mix64((sums[to] - sums[at]) * INVERSE[at])
    piece = np.searchsorted(ends, at, "right")
    owner = np.array([i for i, _ in group])[piece]
    near = np.flatnonzero(piece[1:] == piece[:-1])
    pairs = mix64(hashed[near] * np.uint64(_BASE) + hashed[near + 1])
    low = np.uint64(BUCKETS - 1)
    return np.concatenate([owner, owner[near]]), np.concatenate([hashed & low, (pairs & low) + np.uint64(BUCKETS)]).astype(np.int64)


def repeated_words(words: np.ndarray, texts: np.ndarray, window: int = 3) -> np.ndarray:
    """Which words, given as numbers, lie in a window that occurs twice or more in their text; `texts` are the sorted numbers of their texts."""
    covered = np.zeros(len(words), dtype=bool)
    if len(words) <= window:
        return covered
    key = words
    for j in range(1, window):  # windows of j + 1 words as numbers below their count
        _, key = np.unique(key[: len(words) - j] * (words.max() + 1) + words[j:], return_inverse=True)
    inside = np.flatnonzero(texts[window - 1 :] == texts[: len(key)])
    _, key, n = np.unique(key[inside] * (texts.max() + 1) + texts[inside], return_inverse=True, return_counts=True)
    for j in range(window):
        covered[inside[n[key] >= 2] + j] = True
    return covered


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    return sum(1 for line in lines if WORD.search(line) and (line in seen or seen.add(line)))


FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_facts(texts: list[str]) -> np.ndarray:
    """A row of FACTS for each text. Words are compared as they are; short texts are counted together, a long one word by word in pieces."""
    out = np.zeros((len(texts), len(FACTS)), np.int64)
    ids: dict[bytes, int] = {}
    words, owners, held = [], [], 0

    def count() -> None:
        if sum(map(len, words)):
            w, o = np.concatenate(words), np.concatenate(owners)
            out[:, 0] += np.bincount(o, minlength=len(texts))
            out[:, 4] += np.bincount(o[repeated_words(w, o - o[0])], minlength=len(texts))
        ids.clear(), words.clear(), owners.clear()

    for i, text in enumerate(t.encode("utf-8", "surrogatepass") for t in texts):
        at = 0
        while at < len(text):
            blank = BLANK.search(text, at + SLICE)
            end = blank.end() if blank else len(text)
            found = text[at:end].split()
            words.append(np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found)))
            owners.append(np.full(len(found), i))
            at = end
        held += len(text)
        if held >= SLICE:
            count()
            held = 0
    count()
    for i, text in enumerate(texts):
        out[i, 1] = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
        out[i, 2], out[i, 3] = sum(text.count(c) for c in SYMBOLS), repeated_lines(text)
    return out


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def _counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the only column of `texts`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for group in slices([t.encode("utf-8", "surrogatepass") for t in _texts(batch, 0)]):
                total += np.bincount(features(group)[1], minlength=2 * BUCKETS)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(2 * BUCKETS)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # 2 * BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of documents that labels call good, and none calls poor; null labels and ids say nothing."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")


def fit_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(trusted / raw) of each bucket: 0 where the corpus has nothing, and everywhere where no document is trusted."""
    rows = docs.select("doc_id", "text")
    raw = _counts(rows.select("text"))
    trusted = _counts(spread_join(rows, trusted_ids(labels), "doc_id", ["text"]).select("text"))
    if not trusted.sum():
        return np.zeros(2 * BUCKETS)
    share = raw / raw.sum()
    smoothed = (trusted + PRIOR * share) / (trusted.sum() + PRIOR)
    return np.log(np.divide(smoothed, share, out=np.ones_like(share), where=share > 0))


def score_texts(docs: DataFrame, ratios: np.ndarray, names: tuple[str, ...] = (*FACTS, "score"), text: str = "text") -> DataFrame:
    """`docs` with the base facts (long) and the score (double) of each whole text, under `names`, which `docs` must not have.

    Null and empty texts have no words and the score 0. All columns stay; rows that repeat fare alike.
    """
    at, header = docs.columns.index(text), [*docs.columns, *names]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, at)
            facts, total, n = base_facts(texts), np.zeros(len(texts)), np.zeros(len(texts))
            for group in slices([t.encode("utf-8", "surrogatepass") for t in texts]):
                owner, bucket = features(group)
                total += np.bincount(owner, ratios[bucket], len(texts))
                n += np.bincount(owner, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(facts[:, j]) for j in range(len(FACTS))], pa.array(total / np.maximum(n, 1))], header)

    added = [*(T.StructField(n, T.LongType()) for n in names[:-1]), T.StructField(names[-1], T.DoubleType())]
    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *added]))


def base_failed(n_words: str, n_repeat_words: str) -> Column:
    """Too few words, or too many in repeated windows."""
    return (F.col(n_words) < LEAST_WORDS) | (100 * F.col(n_repeat_words) > MOST_REPEATED * F.col(n_words))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that meet the base rules and whose score reaches the threshold; all columns pass, whatever their names."""
    names = free_names(docs, *FACTS, "score")
    rows = score_texts(docs, fit_ratios(docs, labels), tuple(names))
    return rows.filter(~base_failed(names[0], names[4]) & (F.col(names[5]) >= threshold)).select(*docs.columns)


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, the base facts, base_failed, kept, score): one row per row of `docs`, null ids and repeated rows among them.

    Null texts have no words and so fail the base rules. Other columns are not read. Without trusted documents every score is 0 and the base rules decide alone. No rows in, no rows out.
    """
    rows = docs.select("doc_id", "text")
    scored = score_texts(rows, fit_ratios(rows, labels)).withColumn("base_failed", base_failed("n_words", "n_repeat_words"))
    return scored.select("doc_id", *FACTS, "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")
