import random
import re
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import common, nearjoin, registry

from .helpers import DOCS, FOLDER, documents, prose, sf_documents, tricky


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(texts, threshold=0.8, counted=False):
    """Class of each id; (class, links to other rows) if counted."""
    sets, held, links = sets_of(texts), defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in held[x] if j > i).items():
            if k / (len(s) + len(sets[j]) - k) >= threshold:
                links.update((i, j))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (find(i), links[i]) if counted else find(i) for i in sets}


def counted(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_whole_table(spark):
    assert counted(registry.op8_jaccard(spark, FOLDER)) == brute([(i, t) for i, t, _ in sf_documents()], counted=True)


def test_planted_groups(spark):
    rng, texts = random.Random(5), []
    shared = prose("shared", 70)
    for g in range(12):
        base = prose(g, 120).split()
        for _ in range(g):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = prose(rng.random(), 1)
            texts.append(" ".join(copy))
    texts += [f"{shared} {prose(('own', i), 60)}" for i in range(80)]  # one passage, nothing else in common
    rng.shuffle(texts)
    texts += texts[:9]
    want = brute(list(enumerate(texts)), counted=True)
    assert counted(nearjoin.near_duplicates(documents(spark, texts))) == want
    # Small blocks: groups and buckets are compared block against block.
    assert counted(nearjoin.near_duplicates(documents(spark, texts), block=3)) == want


def test_one_chain_of_links(spark, monkeypatch):
    """Each text is similar to its next ones only, so most members of the component are not linked to each other."""
    words = prose("chain", 400).split()
    texts = [" ".join(words[i * 6 : i * 6 + 120]) for i in range(40)]
    monkeypatch.setattr(nearjoin, "BLOCK_SHINGLES", 500)
    assert counted(nearjoin.near_duplicates(documents(spark, texts), block=8)) == brute(list(enumerate(texts)), counted=True)


def test_recall_of_the_forest():
    depth = nearjoin.shortest_depth()
    assert nearjoin.found_at(0.8, depth) >= nearjoin.RECALL > nearjoin.found_at(0.8, depth + 1) and depth < nearjoin.LEVELS
    rng, hit = np.random.default_rng(2), 0
    for _ in range(200):  # pairs of sets with similarity 0.8
        words = rng.integers(0, 2**63, 100).astype(np.uint64)
        hashes = np.concatenate([np.sort(words[:90]), np.sort(words[10:])])
        bits, _ = nearjoin.signature_bits(hashes, np.array([0, 90, 180]), nearjoin.TRIES)
        values = bits.astype(">u8").view(">u2").reshape(2, nearjoin.TRIES, nearjoin.LEVELS)[:, :, :depth]
        hit += bool((values[0] == values[1]).all(axis=1).any())
    assert hit >= 199


def test_prefixes_are_shortened_until_the_links_found_speak_for_the_target():
    close, borderline = {0.98: 500}, {0.8: 500}
    assert nearjoin.estimated_recall(close, nearjoin.LEVELS) >= nearjoin.RECALL
    assert nearjoin.estimated_recall(borderline, nearjoin.LEVELS) < nearjoin.RECALL <= nearjoin.estimated_recall(borderline, nearjoin.shortest_depth())
    assert nearjoin.estimated_recall({}, nearjoin.LEVELS) < nearjoin.RECALL <= nearjoin.estimated_recall({}, nearjoin.shortest_depth())


def test_sorted_leaves_know_their_longest_match(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 3, (60, 2, nearjoin.LEVELS)).astype(">u2")  # 60 sets, two tries
    words = values.reshape(60, -1).copy().view(">u8").astype(np.uint64).view(np.int64)
    sets = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(words)], "set long, words array<long>")
    got = {(r["trie"], r["set"]): r["matched"] for r in nearjoin.sorted_leaves(sets, 2, 2).collect()}
    shared = lambda a, b: int(np.cumprod(a == b).sum())
    want = {(t, i): max(shared(values[i, t], values[j, t]) for j in range(60) if j != i) for t in range(2) for i in range(60)}
    assert all(got.get(k, 0) == n or got.get(k) == nearjoin.LEVELS for k, n in want.items() if n >= 2)
    assert sum(got[k] != want[k] for k in got) <= 2 * 4  # the ends of the ranges


def test_edges(spark):
    rows = nearjoin.near_duplicates(tricky(spark)).collect()
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows)
    assert got == Counter([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (4, 4, 2), (5, 4, 2), (6, 6, 0), (None, None, 0), (7, 7, 0)])
    kept = nearjoin.one_of_each(tricky(spark))
    assert Counter((r["doc_id"], r["score"]) for r in kept.collect())[4, "score"] == 1
    assert kept.columns == tricky(spark).columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 7, None])
    assert nearjoin.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55)], "a long, b long")
    got = {r["id"]: r["label"] for r in nearjoin.components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 55: 50, 60: 50}


def test_texts_under_one_id_all_count(spark):
    """Different texts with one id are rows like any others; of near duplicates among them one stays."""
    a, b, c = (prose(x, 60) for x in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (2, c), (2, a), (3, b + " end"), (3, c), (1, None), (1, "")], "doc_id long, text string")
    got = Counter(tuple(r) for r in nearjoin.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, 1), (1, 1, 1), (2, 2, 1), (2, 1, 1), (3, 1, 1), (3, 2, 1), (1, 1, 0), (1, 1, 0)])
    kept = Counter((r["doc_id"], r["text"]) for r in nearjoin.one_of_each(docs).collect())
    assert kept == Counter([(1, a), (1, b), (2, c), (1, None), (1, "")])


def test_recall_of_planted_pairs_by_band(spark):
    """Pairs of their own, of every similarity from 0.8 on: nearly none is lost even at the threshold, none above 0.85."""
    rng, pairs = np.random.default_rng(8), []
    while len(pairs) < 900:
        n = int(rng.integers(40, 260))
        a = [f"{len(pairs)}w{x}" for x in rng.integers(0, 10**6, n)]
        b = list(a)
        for at in rng.integers(0, n, int(rng.integers(1, 1 + max(1, n // 40)))):
            b[at] = f"{len(pairs)}new{at}"
        x, y = ({tuple(t[i : i + 5]) for i in range(n - 4)} for t in (a, b))
        similarity = len(x & y) / len(x | y)
        if 0.8 <= similarity < 1 and (similarity < 0.86 or len(pairs) % 3 == 0):
            pairs.append((similarity, " ".join(a), " ".join(b)))
    docs = documents(spark, [t for _, *both in pairs for t in both])
    found = {r["doc_id"]: r["class_id"] for r in nearjoin.near_duplicates(docs).collect()}
    recall = {}
    for low, high in ((0.8, 0.82), (0.82, 0.85), (0.85, 1)):
        of = [found[2 * i] == found[2 * i + 1] for i, (s, *_) in enumerate(pairs) if low <= s < high]
        assert len(of) > 80
        recall[low] = float(np.mean(of))
    assert recall[0.8] >= 0.985 and recall[0.82] >= 0.995 and recall[0.85] == 1


def test_texts_that_nobody_wants_do_not_travel(spark):
    rows = spark.range(200_000).selectExpr("if(id % 1000 = 999, null, id - 50000) as doc_id", "cast(id as string) as text")
    wanted = spark.range(0, 3000).selectExpr("id * 37 - 20000 as doc_id")
    kept = {r["doc_id"] for r in common.sifted(rows, wanted, "doc_id", 3000).collect()}
    there = {r["doc_id"] for r in rows.join(wanted, "doc_id").collect()}
    assert len(there) > 2900 and there <= kept and len(kept) < len(there) + 2000
    assert common.sifted(rows, wanted.limit(0), "doc_id", 0).count() == 0
    full = common.sifted(rows, rows.filter("doc_id is not null"), "doc_id", 199_800)  # as many as there are
    assert full.join(rows.select("doc_id"), "doc_id").count() == 199_800
