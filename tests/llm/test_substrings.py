import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import nearjoin, registry, substrings

from .helpers import DOCS, FOLDER, documents, prose, sf_documents, tricky


def brute(docs, length=50):
    first, out = {}, {}
    for i, raw in sorted(docs, key=lambda x: x[0]):
        starts = [raw[j : j + length] for j in range(len(raw) - length + 1)]
        gone = bytearray(len(raw))
        for j, s in enumerate(starts):
            if first.get(s, i) < i:
                gone[j : j + length] = b"\1" * length
        for s in starts:
            first.setdefault(s, i)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(raw)))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_whole_table(spark):
    assert result(registry.op5_substrings(spark, FOLDER)) == brute([(i, t.encode()) for i, t, _ in sf_documents()])


def test_overlaps_periods_and_edges(spark):
    rng = random.Random(3)
    base = [prose(i, 40) for i in range(6)]
    texts = ["ab" * 200, "x" + "ab" * 100, "a" * 49, "a" * 50, "a" * 300, "zé" * 60, "é" * 60, "\0" * 120, "\0" * 60 + "q"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            at = rng.randrange(len(b))
            parts.append(b[at : at + rng.choice([30, 49, 50, 51, 80, 300])])
        texts.append("".join(parts))
    got = result(substrings.removal_digest(documents(spark, texts)))
    assert got == brute([(i, t.encode()) for i, t in enumerate(texts)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=300), st.integers(1, 4))
def test_order_is_lexicographic(values, words):
    columns = [np.array([(v >> i) & 1 for v in values], dtype=np.uint64) for i in range(words)]
    order, starts = substrings.multikey_order(columns) if values else (np.empty(0, int), np.empty(0, int))
    keys = [tuple(int(c[i]) for c in columns) for i in order]
    assert keys == sorted(keys)
    assert [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] == list(starts)


def test_every_window_has_an_anchor():
    rng = random.Random(1)
    for text in [bytes(rng.randrange(97, 100) for _ in range(700)), b"a" * 200, b"ab" * 90]:
        buffer = substrings.Buffer([text, text[100:]])
        at, doc = buffer.anchors(50)
        for d, t in enumerate((text, text[100:])):
            inside = set((at[doc == d] - buffer.starts[d]).tolist())
            assert all(any(i + o in inside for o in range(35)) for i in range(len(t) - 49))


def test_tricky_rows_and_columns(spark):
    rows = substrings.remove_repeated(tricky(spark), decoded=True)
    assert "kept" in rows.columns
    got = {}
    for r in rows.collect():
        got.setdefault(r["doc_id"], []).append((r["n_removed"], r["text"]))
    text = prose("a", 60)
    assert got[4] == [(0, text)] * 2 and got[None] == [(0, text)]
    assert got[5] == [(len(text), "")]
    assert got[1] == [(0, None)] and got[2] == [(0, "")] and got[6][0][0] == 0
    assert substrings.removal_digest(spark.createDataFrame([], DOCS)).count() == 0
    cut = substrings.remove_repeated(documents(spark, ["é" * 40 + "a", "b" + "é" * 40 + "c"]), length=50, decoded=True)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {0: "é" * 40 + "a", 1: "bc"}


def test_a_passage_of_many_documents_is_not_one_group(spark, monkeypatch):
    whole = substrings.masks_of_prefix_groups

    def small_groups(order, starts, *rest):
        if len(starts) and np.diff(np.append(starts, len(order))).max() > 20:
            raise ValueError("a prefix with more than 20 anchors in one task")
        return whole(order, starts, *rest)

    monkeypatch.setattr(substrings, "HOT", 20, raising=False)
    monkeypatch.setattr(substrings, "masks_of_prefix_groups", small_groups)
    passage, texts = prose("shared", 30), []
    for i in range(240):
        own = [prose(f"own {i} {j}", 12) for j in range(2)]
        texts.append(f"{own[0]} {passage[i % 3 :]}{passage[:60] if i % 5 == 0 else ''} {own[1]}" if i % 3 else " ".join(own))
    texts += [" " * 400, "x" + " " * 300, texts[1], texts[2] + texts[4]]
    assert result(substrings.removal_digest(documents(spark, texts))) == brute([(i, t.encode()) for i, t in enumerate(texts)])


def test_a_prefix_seen_in_two_documents_sends_two_rows():
    w0, w1 = np.array([7] * 1000 + [8, 8, 9], np.uint64), np.array([1] * 1000 + [2, 2, 3], np.uint64)
    doc = np.array([*range(1000), 5, 5, 6])
    shared, ends, sizes = substrings.shared_here(w0, w1, doc)
    assert shared.tolist() == [True] * 1000 + [False] * 3
    assert doc[ends].tolist() == [[0], [999]] and sizes.tolist() == [1000]


def test_bytes_decide_where_hashes_agree():
    rng = np.random.default_rng(0)
    context = rng.integers(0, 2, (40, 5)).astype(np.uint8)
    doc, rows = rng.integers(0, 6, 40), np.arange(40)
    for h in (np.zeros(40, np.uint64), context[:, 1].astype(np.uint64)):  # every hash the same; some
        got = substrings.first_windows(h, doc, context, rows, 1, 3)
        want = [not any((context[j, 1:4] == context[i, 1:4]).all() and doc[j] < doc[i] for j in range(40)) for i in range(40)]
        assert got.tolist() == want


def test_bytes_decide_in_every_step(spark, monkeypatch):
    first, least = substrings.earliest, substrings.least_windows

    def few_hashes(h, doc):
        return first(h & np.uint64(7), doc)

    def few_window_hashes(*args):
        mask, row, a, h = least(*args)
        return mask, row, a, h & np.uint64(3)

    monkeypatch.setattr(substrings, "HOT", 4)
    monkeypatch.setattr(substrings, "earliest", few_hashes)
    monkeypatch.setattr(substrings, "least_windows", few_window_hashes)
    passage = prose("shared", 30)
    texts = [f"{prose(f'own {i}', 8)} {passage[i % 3 :]} {prose(f'end {i}', 8)}" for i in range(60)] + [passage, passage, prose("alone", 40)]
    assert result(substrings.removal_digest(documents(spark, texts))) == brute([(i, t.encode()) for i, t in enumerate(texts)])


def test_few_prefixes_are_hot_at_any_size():
    for n_bytes in (0, 10**9, 10**14):
        for ranges in (16, 4000, 400_000):
            hot = substrings.hot_size(n_bytes, ranges)
            assert hot >= substrings.HOT and n_bytes // hot <= substrings.HOT_PER_RANGE * ranges


def test_passes_hold_little_beside_their_batch():
    """Before, all texts of a batch were held as bytes, and 4 MB of them went through one pass, which took about 100 MB."""
    texts = [None, "", "é" * 30, *(f"{i} " * (1 << 16) for i in range(100, 140)), "x" * (3 << 20), "end"]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "text": texts})
    for passes, pass_bytes in ((substrings._passes(batch, "text"), substrings.PASS_BYTES), (nearjoin._passes(batch, 1), nearjoin.PASS_BYTES)):
        found, end = [], 0
        for first, last, some in passes:
            assert first == end and len(some) == last - first and (last == first + 1 or sum(map(len, some)) <= pass_bytes)
            end = last
            found += some
        assert found == [(t or "").encode() for t in texts]
    short = batch.slice(0, len(texts) - 2)
    tracemalloc.start()
    for _, _, some in substrings._passes(short, "text"):
        substrings.Buffer(some).anchors(50)
    anchors = tracemalloc.get_traced_memory()[1]
    nearjoin._POWERS.clear()
    tracemalloc.reset_peak()
    for _, _, some in nearjoin._passes(short, 1):
        nearjoin.shingles(some)
    sets = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert anchors < 60 << 20 and sets < 140 << 20, (anchors, sets)
