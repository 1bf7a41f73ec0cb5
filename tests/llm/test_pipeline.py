import os
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common
from tessera.sources.tables import table

from .helpers import FOLDER, prose
from .test_nearjoin import brute
from .test_substrings import brute as cut


def test_stages_on_the_small_tables(spark):
    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.stored(stage(spark, docs, FOLDER))
        if i < 4:
            assert docs.columns == columns
        kept[name] = docs.collect()
    one = {r["doc_id"]: r["text"] for r in kept["language_id"]}
    assert set(before) - set(one) == {i for i, t in before.items() if not re.search(r"[^\W\d_]", t)}
    groups = brute(list(one.items()))
    two = {r["doc_id"]: r["text"] for r in kept["near_duplicates"]}
    assert two == {i: one[i] for i, c in groups.items() if i == c}
    three = {r["doc_id"]: r for r in kept["repeated_passages"]}
    for i, (n, removed, _, _) in cut([(i, t.encode()) for i, t in two.items()]).items():
        if i not in three:
            assert removed
        elif removed:
            assert n - removed - 6 <= len(three[i]["text"].encode()) <= n - removed and three[i]["n_chars"] == len(three[i]["text"])
        else:
            assert three[i]["text"] == two[i]
    four = {r["doc_id"] for r in kept["target_mixture"]}
    assert four <= set(three) and len(four) >= 0.9 * len(three)
    assert {r["doc_id"] for r in kept["packed_sequences"]} == four
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "target_mixture", "packed_sequences"]


CLASHING = ("score", "lang_pred", "kept", "n_removed", "n_bytes", "n_spans", "_id", "_salt", "__hash", "__home", "id_", "hash_", "salt_", "copies_", "text_hash", "tokens", "p", "rate")


def test_stages_keep_rows_and_columns(spark):
    """Repeated ids with different texts, nulls, empty and repeated rows, a long text, columns that clash with what operators use."""
    long = prose("long", 30000)
    rows = [(1, prose("a", 60)), (1, prose("b", 60)), (2, prose("c", 60)), (2, prose("c", 60)), (3, prose("a", 60)), (None, prose("d", 60)), (4, None), (5, ""), (6, long), (7, "12 34")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'mine' as `{c}`" for c in CLASHING])
    mine = lambda df: df.columns == docs.columns and all(r[c] == "mine" for r in df.collect() for c in CLASHING)
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    one = common.stored(corpus_pipeline.language_id(spark, docs, FOLDER))
    assert mine(one) and pairs(one) == Counter((i, t) for i, t in rows if t and t != "12 34")
    two = common.stored(corpus_pipeline.near_duplicates(spark, docs, FOLDER))
    assert mine(two) and pairs(two) == Counter({(i, t): 1 for i, t in rows if (i, t) != (3, prose("a", 60))})
    three = common.stored(corpus_pipeline.repeated_passages(spark, docs, FOLDER))
    assert mine(three) and pairs(three) == Counter((i, t) for i, t in rows if (i, t) != (3, prose("a", 60)))
    four = common.stored(corpus_pipeline.target_mixture(spark, docs, FOLDER))
    assert mine(four) and set(pairs(four)) <= set(rows)
    assert {r["doc_id"] for r in corpus_pipeline.packed_sequences(spark, docs, FOLDER).collect()} == {i for i, _ in rows}


def test_stages_of_an_empty_table(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER)
        assert got.count() == 0 and (name == "packed_sequences" or got.columns == docs.columns)


def test_a_missing_language_is_filled_in(spark):
    docs = table(spark, FOLDER, "documents")
    blank = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    got = corpus_pipeline.language_id(spark, blank, FOLDER).select("doc_id", F.col("lang").alias("found")).join(docs, "doc_id").filter("doc_id % 3 = 0")
    assert got.filter("found = lang").count() >= 0.95 * got.count() > 0


def test_runs_delete_their_own_tables_alone(spark, monkeypatch):
    """Results built lazily before and between pipeline runs can still be read after them; what a finished stage stored is gone."""
    from tessera.llm import registry

    seen = []

    def stage(session, docs, folder):
        half = common.stored(docs.filter("doc_id % 2 = 0"))
        seen.append(half)
        return half.limit(50)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("second", lambda s, d, f: stage(s, d, f).filter("doc_id % 4 = 0"))])
    packed, shards = registry.op1_packing(spark, FOLDER), registry.op6_sharding(spark, FOLDER)
    first = corpus_pipeline.run(spark, FOLDER)
    second = corpus_pipeline.run(spark, FOLDER)
    n = table(spark, FOLDER, "documents").count()
    assert packed.select("doc_id").distinct().count() == n and shards.count() == n
    assert first.count() == second.count() == 25
    alive = [os.path.exists(t.inputFiles()[0].removeprefix("file://")) for t in seen]
    assert alive == [False, True, False, True]
