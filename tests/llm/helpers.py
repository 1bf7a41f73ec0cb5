import hashlib
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0, langs=None):
    rows = [(start + i, t, (langs or ["en"])[i % len(langs or ["en"])], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def word(i):
    return hashlib.md5(str(i).encode()).hexdigest()[:6].translate(str.maketrans("0123456789", "ghijklmnop"))


def prose(seed, n):
    return " ".join(word(f"{seed}/{i}") for i in range(n))


def tricky(spark):
    """Null and empty texts, repeated rows, a long text, a null id, and columns that clash with what operators use."""
    rows = [(1, None), (2, ""), (3, "  \n"), (4, prose("a", 60)), (4, prose("a", 60)), (5, prose("a", 60)), (6, "é" * 40 + " x" * 3000), (None, prose("a", 60)), (7, "12 34 !!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "source", "score", "predicted", "kept", "n", "shard", "slot", "host", "path", "rank", "buckets", "tokens", "p", "rate", "_hash", "length", "copies"):
        df = df.selectExpr("*", f"'{c}' as {c}")
    return df


def sf_documents():
    path = f"{FOLDER}/documents.parquet"
    return duckdb.sql(f"select doc_id, text, lang from '{path + '/*.parquet' if os.path.isdir(path) else path}' order by doc_id").fetchall()
