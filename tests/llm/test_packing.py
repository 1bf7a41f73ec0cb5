import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, registry

from .helpers import DOCS, FOLDER, sf_documents, tricky

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXACT = Tokenizer.from_file(PATH)
EXACT.encode_special_tokens = True
FAST = packing.ByteBpe(PATH)


def exact(text):
    return EXACT.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'aAlsreéß1<|>endoftx", max_size=60))
def test_ids_equal_the_library(text):
    assert FAST.ids(text).tolist() == exact(text)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40), max_size=32))
def test_plan_places_each_piece_once(counts):
    bins = defaultdict(lambda: np.zeros(32, int))
    ranks = defaultdict(list)
    large = defaultdict(int)
    for length, first, n, start, offset in packing.plan_bins(dict(counts), 32):
        ranks[length] += range(first, first + n)
        for b in range(start, start + n):
            bins[b][offset : offset + length] += 1
            assert offset + length <= 32
            large[b] += 3 * length > 32
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    assert all(v <= 2 for v in large.values())
    for cells in bins.values():
        used = cells.sum()
        assert (cells[:used] == 1).all() and (cells[used:] == 0).all()
    assert sorted(bins) == list(range(len(bins)))


def test_whole_table(spark):
    rows = registry.op1_packing(spark, FOLDER).collect()
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    for doc, text, _ in sf_documents():
        ids = np.array([*exact(text), 2], dtype="<u4")
        pieces = sorted(found[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert sum(r["length"] for r in pieces) == len(ids) and all(r["length"] == 1024 for r in pieces[1:])
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


def test_edges(spark):
    rows = packing.pack_documents(tricky(spark), PATH).collect()
    one = [r for r in rows if r["doc_id"] in (1, 2)]
    assert [(r["length"], r["ids_crc32"]) for r in one] == [(1, zlib.crc32(np.array([2], "<u4").tobytes()))] * 2
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and any(r["doc_id"] is None for r in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (3000, [(0, 952), (952, 1024), (1976, 1024)])])
def test_cut(n, want):
    assert packing.cut(n, 1024) == want


UNCHANGED = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "é b\n", "<|", "|>", "endoftext", "\t12"]), max_size=12))
def test_added_tokens_get_their_ids(parts):
    text = "".join(parts)
    assert FAST.ids(text).tolist() == UNCHANGED.encode(text, add_special_tokens=False).ids
    assert FAST.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
