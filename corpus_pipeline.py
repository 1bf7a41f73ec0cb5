"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, nearjoin, packing, substrings
from tessera.llm.common import Scope, free_names, stored, table

#: A document goes if no language is found in it, or if the likeliest one has a smaller probability.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too) go, and those whose likeliest language scores below LEAST_SCORE; a missing lang is filled in.

    The score is low where the learned languages are about equally likely. It doesn't tell unlearned languages: texts in these mostly score as high as others and stay.
    Only id, text and lang are read, so other columns, whatever their names, pass through. Repeated rows fare alike. An empty table stays empty.
    """
    pred, score = free_names(docs, "lang_pred", "score")
    model = language.train(language.labelled_sample(docs))
    marked = language.identify(docs, model, names=(pred, score)).filter((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE))
    if "lang" in docs.columns:
        marked = marked.withColumn("lang", F.coalesce(F.col("lang"), F.col(pred)))
    return marked.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Rows without an id or without words (null and empty texts) stay; rows that repeat id and text count once; different texts under one id are
    documents of their own. All columns pass through. An empty table stays empty.
    """
    return nearjoin.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of 50 bytes or more that a document with a smaller id has too are cut out; documents of which nothing is left go.

    n_chars follows the text where it was cut. Null texts, empty ones and rows without an id stay as they are; rows with one id take
    nothing from each other. Other columns, whatever their names, pass through. An empty table stays empty.
    """
    removed, size, runs, kept = names = free_names(docs, "n_removed", "n_bytes", "n_spans", "kept")
    cut = substrings.remove_repeated(docs, decoded=True, names=(size, removed, runs, kept))
    cut = cut.filter(~((F.col(removed) > 0) & (F.col("text") == "")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.drop(*names)


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their fitted rates say: none, once or several times.

    Null and empty texts have no tokens and the prior's posterior; equal rows fare alike. All columns pass through, whatever their names. An empty table stays empty.
    """
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every row, repeated ones too, with its sequence and offset; a null or empty text is one piece of the end id alone.

    Other columns are not read. An empty table gives an empty result.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("target_mixture", target_mixture),
    ("packed_sequences", packed_sequences),
]

#: The trained and iterative stages can't be said in SQL; they are tested against brute force and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scope() as own:
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = stored(docs)
                own.clear(spark, keep=docs)  # what the stage stored for itself; other runs' tables stay
    return docs
