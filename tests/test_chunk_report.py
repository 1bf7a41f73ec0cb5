"""The chunker as a table function: failures are rows and counts, never the end of a job."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import chunking, structure


def test_failures_are_rows_and_counts(spark):
    files = [("a.ts", "function f() {}\nclass C { m() {} }"), ("b.ts", "const x = `"), ("c.py", "def ("), ("d.go", "func f( {"), ("e.cpp", "int x;"), ("f.txt", "no"), ("g.ts", ""), ("h.ts", None), (None, "x"), ("a.ts", "function f() {}")]
    watch = Observation("chunks")
    rows = chunking.chunk_report(spark.createDataFrame(files, "path string, content string").withColumn("error", F.lit("mine")).withColumn("language", F.lit(1)), watch).collect()
    assert watch.get == {"chunks": 8, "whole_files": 4, "failures": 3}
    errors = {r["file_path"]: r["error"] for r in rows if r["error"]}
    assert errors.keys() == {"b.ts", "c.py", "d.go"} and errors["b.ts"] == "LexingError: a template that does not end" and errors["c.py"].startswith("SyntaxError: ")
    assert sorted(r["symbol_name"] for r in rows if r["symbol_type"] != "file") == ["C", "f", "f", "m"]
    assert chunking.chunk_report(spark.createDataFrame([], "path string, content string")).count() == 0


def test_outlines_keep_the_order_of_the_file(spark):
    files = spark.createDataFrame([("a.ts", "interface B { }\nclass Z { y() { } x() { } }\nfunction a() { }\ninterface A { }\nclass Y { }"), ("b.py", "x = 1")], "path string, content string")
    out = {r["file_path"]: (r["classes"], r["interfaces"], r["functions"]) for r in chunking.file_outlines(chunking.symbol_chunks(files)).collect()}
    assert out == {"a.ts": (["Z", "Y"], ["B", "A"], ["Z.x", "Z.y", "a"]), "b.py": ([], [], [])}


def test_facts_become_edges(spark):
    files = [("src/a.ts", "import { x } from './b'; import y from '../lib/c.js';\nimport './missing'; import r from 'react'"), ("src/b.tsx", "import a from './a';\n// import c from '../lib/c.js'"), ("lib/c.js", "const no = `import a from '../src/a'`"), ("lib/d.ts", "import {")]
    edges = structure.file_edges(spark.createDataFrame(files, "path string, content string"))
    assert sorted(map(tuple, edges.collect())) == [("src/a.ts", "lib/c.js"), ("src/a.ts", "src/b.tsx"), ("src/b.tsx", "src/a.ts")]
