import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from tessera.llm import registry, trie

from .helpers import FOLDER

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[c].append(((turn is not None, turn or 0, digest), (role, text)))
    said = {c: [s for _, s in sorted(turns)] for c, turns in by.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = said.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def brute(whole):
    """Every prefix of every conversation in a dictionary, sums by walking each node's ancestors."""
    members = defaultdict(list)
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    sha = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p, m)) for p, m in members.items())


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_by_brute_force(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{FOLDER}/conversations.parquet'").fetchall()
    assert got(registry.op12_trie(spark, FOLDER)) == brute(rebuilt(rows))


def talk(seed, n):
    return [(("user", "assistant")[i % 2], f"{seed}-{i}é") for i in range(n)]


@pytest.mark.parametrize(("segment", "local"), [(64, 1024), (3, 4), (2, 1)])
def test_levels_and_buckets(spark, monkeypatch, segment, local):
    """Many levels and dealt buckets, copies that end where others go on, prefixes that end at a segment's end."""
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "LOCAL", local)
    monkeypatch.setattr(trie, "PIECE", 2)
    rows, c = [], 0
    for said in [*[talk("a", 7)] * 4, talk("a", 3), talk("a", 6), talk("a", 9), talk("a", 4) + talk("b", 5), *[talk("c", k) for k in range(1, 8)], *[talk(k, 2) for k in "defgh"], talk("a", 7), talk("c", 6), talk("z", 12)]:
        rows += [(c, i, *t) for i, t in enumerate(said)]
        c += 1
    assert got(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rebuilt(rows))


def test_turns_and_copies_that_are_hot(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_FLOOR", 32)
    monkeypatch.setattr(common, "HOT_PARTS", 16)
    monkeypatch.setattr(trie, "LOCAL", 8)
    rows = [(c, i, "user", f"{i}") for c in range(60) for i in range(3)]
    rows += [(100 + c, i, "user", "0" if i == 0 else f"{c}-{i}") for c in range(40) for i in range(4)]
    rows += [(1000, i, "user", f"long {i % 7}") for i in range(400)] + [(1005, i, "user", f"long {i % 7}") for i in range(300)]
    assert got(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rebuilt(rows))


def test_edges(spark):
    rows = [(7, 1, "user", "a"), (7, None, None, None), (7, 0, "", ""), (7, 2, "user", None), (7, 2, "user", None), (None, 0, "user", "lost"), (8, 0, None, "b"), (8, 0, None, "b"), (-3, 0, "x" * 300, "y" * 5000), (5, 0, "user", "a"), (12, 3, "assistant", "é\n")]
    rows += [(9 + 5 * k, 0, "user", "one turn, mostly gone") for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' as {c}" for c in ("rank", "id", "size", "depth", "bucket", "rep", "n", "digest", "ends", "top")])
    want = brute(rebuilt(rows))
    assert any(not said for said in rebuilt(rows).values()) and got(trie.conversation_trie(df)) == want
    out = trie.conversation_trie(spark.createDataFrame([], SCHEMA))
    assert sorted(out.columns) == sorted(COLUMNS) and out.count() == 0
    assert got(trie.conversation_trie(spark.createDataFrame([(4, 0, "user", "a")], SCHEMA))) == brute(rebuilt([(4, 0, "user", "a")]))
