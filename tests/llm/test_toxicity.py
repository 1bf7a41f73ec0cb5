import itertools

import duckdb
import numpy as np
import pytest

from tessera.llm import registry, toxicity

from .helpers import DOCS, prose, tricky

LARGE = "/root/testdata/sf0.1"


def slow_kernel(s, t):
    s, t = f"\1{s}\2", f"\1{t}\2"
    near = lambda x: [c for c in itertools.combinations(range(len(x)), 3) if c[2] - c[0] < toxicity.SPAN]
    return sum(toxicity.DECAY ** (a[2] - a[0] + b[2] - b[0] + 2) for a in near(s) for b in near(t) if all(s[i] == t[j] for i, j in zip(a, b, strict=True)))


@pytest.mark.parametrize(("s", "t"), [("idiot", "idiot"), ("idxiot", "idiot"), ("aaaa", "aaa"), ("abcabc", "acbcab"), ("été", "tété"), ("😀й字é", "字😀йз"), ("ab", "ab"), ("x", "xy")])
def test_kernel_by_enumeration(s, t):
    found = toxicity.Subsequences.of([s, t])
    want = slow_kernel(s, t) / (slow_kernel(s, s) * slow_kernel(t, t)) ** 0.5
    assert float(found.apply([s], found.table([t]))[0, 0]) == pytest.approx(want, rel=1e-4)


def test_every_letter_counts():
    """Two hundred letters: the subsequences that the words have are numbered one by one, with the same values."""
    words = ["".join(chr(0x4E00 + 7 * i + j) for j in range(12)) for i in range(20)]
    few, many = toxicity.Subsequences.of(words, dense=1 << 40), toxicity.Subsequences.of(words)
    assert few.known is None and many.known is not None
    for other in (words[3], words[3][:5] + "x" + words[4][5:], "none"):
        assert np.allclose(few.apply([other], few.table(words[:6])), many.apply([other], many.table(words[:6])))
        want = [slow_kernel(other, w) / (slow_kernel(other, other) * slow_kernel(w, w)) ** 0.5 for w in words[:6]]
        assert np.allclose(many.apply([other], many.table(words[:6]))[0], want, rtol=1e-4, atol=1e-6)


def test_scores_of_texts_by_enumeration():
    """A text's decision is the greatest over its words of the landmarks' kernel values under the machine, subsequence by subsequence."""
    m = toxicity.train([(prose(i, 20) + (" dolthead" if i % 2 else ""), i % 2) for i in range(40)])
    text = "a plain text, with dolt-head inside"
    words = [p for w in toxicity.tokens(text) for p in toxicity.pieces(w)]

    def slow(word):
        w, total = f"\1{word}\2", 0.0
        for c in itertools.combinations(range(len(w)), 3):
            letters = [int(m.subsequences.letters[ord(w[i])]) for i in c]
            if c[2] - c[0] < toxicity.SPAN and all(letters):
                total += float(m.weights[(letters[0] * m.subsequences.size + letters[1]) * m.subsequences.size + letters[2], 0]) * toxicity.DECAY ** (c[2] - c[0] + 1)
        return total / slow_kernel(word, word) ** 0.5 + m.bias

    assert m.subsequences.known is None
    assert toxicity.Scorer(m).texts([text])[0] == pytest.approx(max(map(slow, words)), rel=1e-3)


def test_tolerates_inserted_characters_and_spelling_out():
    rng = np.random.default_rng(0)
    insults = ["wretchling", "dolthead"]
    samples = [(prose(i, 40) + (f" {insults[i % 2]} " if i % 3 == 0 else " ") + prose(-i, 10), int(i % 3 == 0)) for i in range(240)]
    m = toxicity.train(samples)
    score = lambda t: m.probability(max(m.decide([p for w in toxicity.tokens(t) for p in toxicity.pieces(w)])))
    assert score("you wretchling") > 0.5 and score("you wret-chling!") > 0.5 and score("d o l t h e a d") > 0.5
    assert np.mean([score(prose(("clean", i), 40)) < 0.5 for i in rng.integers(10**6, 10**7, 40)]) >= 0.95


def test_held_out_accuracy(spark):
    label = dict(duckdb.sql(f"select doc_id, toxic from '{LARGE}/labels.parquet'").fetchall())
    rows = registry.op9_toxicity(spark, LARGE).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    right = [r["predicted"] == label[r["doc_id"]] for r in held]
    assert np.mean(right) >= 0.92 > np.mean([label[r["doc_id"]] == 0 for r in held])  # more than saying 0 always
    caught = [r["predicted"] for r in held if label[r["doc_id"]]]
    assert np.mean(caught) >= 0.8 and sum(caught) >= 0.8 * sum(r["predicted"] for r in held)  # recall and precision
    pos = [r["score"] for r in held if label[r["doc_id"]]]
    neg = [r["score"] for r in held if not label[r["doc_id"]]]
    assert np.mean([p > n for p in pos for n in neg]) >= 0.9


def test_edges(spark):
    m = toxicity.train([("nasty words here", 1), ("kind words there", 0)] * 5)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(tricky(spark), m).collect()}
    assert got[1] == got[2] == got[3] == 0.0 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.train([]) is None and toxicity.train([("a", 1)]) is None
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_held_out(spark.createDataFrame([], DOCS), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_held_out(tricky(spark), labels.limit(0)).collect()} == {0.0}
    assert toxicity.pieces("x" * 45) == ["x" * 20, "x" * 20, "x" * 20, "x" * 15]
    assert toxicity.pieces("(ab)") == ["ab"] and toxicity.pieces("--") == []


def test_sample_is_what_hashes_lowest_however_many_labels_there_are(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as label")
    labels = labels.unionByName(labels.filter("doc_id = 1500"))
    got, share = toxicity.labelled_sample(docs, labels, per_class=5)
    rows = sorted((r["h"], r["doc_id"], r["label"]) for r in labels.distinct().selectExpr("xxhash64(doc_id) as h", "doc_id", "label").collect())
    want = [(f"text {i}", label) for wanted in (0, 1) for _, i, label in [x for x in rows if x[2] == wanted][:5]]
    assert sorted(got) == sorted(want) and abs(share - 2 / 3) < 1e-9


def test_every_insult_of_a_text_is_learned():
    """Texts hold several insults at once; each of them tells, though none is any text's only one."""
    rng = np.random.default_rng(4)
    insults = ["wretchling", "scumfoot", "dolthead", "grubface"]
    samples = [(f"{prose(('a', i), 25)} {' '.join(rng.choice(insults, 3, replace=False))} {prose(('b', i), 25)}", 1) for i in range(60)]
    samples += [(prose(("c", i), 50), 0) for i in range(60)]
    m = toxicity.train(samples)
    assert min(m.probability(m.decide([w])[0]) for w in insults) > 0.5


def test_landmarks_are_spread_out():
    words = ["aaaa", "aaab", "zzzz", "zzzy", "mnop"]
    assert toxicity.spread_out(words, 3) in (["aaaa", "zzzz", "mnop"], ["aaaa", "mnop", "zzzz"]) and toxicity.spread_out(words[:2], 9) == ["aaaa", "aaab"]
