import zlib

import numpy as np

from tessera.llm import language, registry

from .helpers import DOCS, FOLDER, documents, sf_documents, tricky


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = language.Gru(rng.normal(0, 0.5, (9, 256)), rng.normal(0, 0.5, (6, 3)), rng.normal(0, 0.5, (3, 3)))
    data = rng.integers(0, 5, (7, 4)).astype(np.uint8)
    pull = rng.normal(0, 1, (7, 3, 4))
    loss = lambda: float((language.run_gru(p, data)[0].astype(float) * pull).sum())
    _, trace = language.run_gru(p, data, keep=True)
    g = language._back(p, data, trace, pull)
    for name, at in (("x", (4, 2)), ("x", (8, 1)), ("x", (0, 3)), ("u", (1, 2)), ("u", (5, 0)), ("v", (2, 1))):
        a = getattr(p, name)
        old, step = a[at], 1e-3
        a[at] = old + step
        up = loss()
        a[at] = old - step
        down = loss()
        a[at] = old
        assert abs((up - down) / (2 * step) - getattr(g, name)[at]) < 2e-2 * max(1, abs(getattr(g, name)[at]))


def test_windows_cover_whole_texts():
    texts = [b"a" * 64, b"", b"b" * 65, b"c"]
    data, owner, sizes = language.windows(texts)
    assert sizes.tolist() == [64, 64, 1, 1] and owner.tolist() == [0, 2, 2, 3]
    assert b"".join(row[:n].tobytes() for row, n in zip(data, sizes, strict=True)) == b"".join(texts)


def test_held_out_accuracy(spark):
    want = {i: lang for i, _, lang in sf_documents()}
    rows = registry.op4_language(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) >= 0.95


def test_edges(spark):
    model = language.train([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de")], steps=60)
    rows = language.identify(tricky(spark), model)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows.collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 7)) and got[4][0] in ("en", "de")
    assert language.train([]) is None
    assert {r["lang_pred"] for r in language.identify(tricky(spark), None).collect()} == {"und"}
    assert language.identify_held_out(spark.createDataFrame([], DOCS)).count() == 0
    unlabelled = documents(spark, ["some words here"]).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert language.identify_held_out(unlabelled).first()["lang_pred"] == "und"
    assert language.predict(model, ["der hund und die katze"])[0][0] == "de"
