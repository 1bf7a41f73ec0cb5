"""Context assembly, labels, guards and markdown queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import joined, stripped, summary_text
from tessera.operators.budget import running_before
from tessera.plans.registry import query
from tessera.sources.tables import table

#: What stands behind a patch that was cut.
MARK = "...[cut]"


@query(f"""
WITH l AS (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, CAST(CASE WHEN n_chars > 8000 - before THEN 8000 - before + {len(MARK)} ELSE n_chars END AS BIGINT) AS emitted, n_chars > 8000 - before AS cut FROM l WHERE before < 8000
""")
def patch_budget(spark: SparkSession, folder: str) -> DataFrame:
    """A running budget of 8000 characters a source: the text that crosses it is cut and marked, later ones are left out.

    Lengths alone are summed up in order, by blocks of ids, so that a hot source is many tasks; only the few texts within a budget are fetched.
    """
    docs = table(spark, folder, "documents")
    lengths = running_before(docs.select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", "before", budget=8000).withColumn("left", 8000 - F.col("before"))
    rows = lengths.join(docs.select("source", "doc_id", "text"), ["source", "doc_id"])
    cut = F.col("n_chars") > F.col("left")
    patch = F.when(cut, F.concat(F.substring("text", 1, F.col("left").cast("int")), F.lit(MARK))).otherwise(F.col("text"))
    return rows.select("source", "doc_id", F.length(patch).cast("long").alias("emitted"), cut.alias("cut"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat_ws(chr(10), nullif(source, ''), 'about ' || doc_id, lang || '. ' || source, 'k, ' || lang)
  WHEN 1 THEN concat_ws(chr(10), 'about ' || doc_id, lang || '. ' || source) WHEN 2 THEN concat_ws(chr(10), 'about ' || doc_id, lang, lang || ', ' || source, 'k, ' || lang)
  WHEN 3 THEN concat_ws(chr(10), nullif(source, ''), 'about ' || doc_id, source, 'k, ' || lang)
  ELSE concat_ws(chr(10), 'about ' || doc_id, nullif(source, ''), '{"purpose":"' || source || '","summary":"about ' || doc_id || '"}') END AS text FROM documents
""")
def embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    """What is embedded of a summary: which fields, and how lists are joined, goes by the kind of node; empty fields go."""
    n, about, two = F.col("doc_id") % 5, F.concat(F.lit("about "), F.col("doc_id").cast("string")), F.array("lang", "source")
    words = F.array(F.lit("k"), F.col("lang"))
    kind = F.when(n == 0, "file").when(n == 1, "component").when(n == 2, "Architecture").when(n == 3, "repository").otherwise("other")
    file = F.to_json(F.struct(F.col("source").alias("purpose"), about.alias("summary"), two.alias("responsibilities"), words.alias("keywords")))
    component = F.to_json(F.struct(F.lit("").alias("purpose"), about.alias("summary"), two.alias("responsibilities"), F.array().cast("array<string>").alias("keywords")))
    architecture = F.to_json(F.struct(about.alias("summary"), F.col("lang").alias("architectureStyle"), two.alias("majorLayers"), F.lit(None).cast("array<string>").alias("requestFlows"), words.alias("keywords")))
    repository = F.to_json(F.struct(F.col("source").alias("purpose"), about.alias("summary"), F.array("source").alias("features"), words.alias("keywords")))
    other = F.to_json(F.struct(F.col("source").alias("purpose"), about.alias("summary")))
    payload = F.when(n == 0, file).when(n == 1, component).when(n == 2, architecture).when(n == 3, repository).otherwise(other)
    return table(spark, folder, "documents").select("doc_id", summary_text(kind, payload).alias("text"))


@query("""
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '^#{1,6} ')) AS headings, count(*) FILTER (WHERE regexp_matches(line, '^[-*] ')) AS items, count(*) FILTER (WHERE line = '') AS blanks
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id
""")
def markdown_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by what they are in markdown."""
    lines = F.split("text", "\n", -1)
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    return table(spark, folder, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), count("^#{1,6} ").alias("headings"), count("^[-*] ").alias("items"), count("^$").alias("blanks"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
b AS (SELECT doc_id, k, k % 6 AS t, trim(line, ' ' || chr(9) || chr(13)) AS line FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS position, CASE t WHEN 0 THEN 'fence' WHEN 1 THEN 'heading' WHEN 2 THEN 'item' WHEN 3 THEN 'numbered' WHEN 4 THEN 'quote' ELSE 'paragraph' END AS kind,
  CASE t WHEN 0 THEN CASE WHEN k % 4 = 0 THEN 'py' ELSE 'code' END WHEN 1 THEN '##' WHEN 2 THEN '*' WHEN 3 THEN CAST(k AS VARCHAR) WHEN 4 THEN '>' END AS mark,
  CASE t WHEN 1 THEN 'c' || k WHEN 2 THEN 'b ' || '`' || k || '`' WHEN 4 THEN '' ELSE '' END AS marked
FROM b
""")
def markdown_block_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of texts whose lines become fences (which hold lines that look like others), headings, items, numbered items, quotes and paragraphs, with code, bold and italic marks."""
    from tessera.operators.markdown import block_rows

    def shaped(line: Column, k: Column) -> Column:
        n, flat = k.cast("string"), F.translate(line, "`*", "''")
        return (
            F.when(k % 6 == 0, F.concat(F.when(k % 4 == 0, "````py").otherwise("````"), F.lit("\n# no heading\n```\n- "), flat, F.lit("\n````")))
            .when(k % 6 == 1, F.concat(F.lit("## **c"), n, F.lit("** "), flat)).when(k % 6 == 2, F.concat(F.lit("* *b **`"), n, F.lit("`*** "), flat))
            .when(k % 6 == 3, F.concat(n, F.lit(". x"), flat)).when(k % 6 == 4, F.concat(F.lit("> x"), flat)).otherwise(F.concat(F.lit("x"), flat))
        )

    docs = table(spark, folder, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), shaped), "\n").alias("text"))
    inline = F.concat(F.array_join("bold", ""), F.array_join("code", ""))
    return block_rows(docs).select("doc_id", F.col("position").cast("long").alias("position"), "kind", "mark", F.when(F.col("kind") == "heading", F.array_join("bold", "")).when(F.col("kind") == "item", F.concat(F.lit("b "), F.lit("`"), F.array_join("code", ""), F.lit("`"))).otherwise(inline).alias("marked"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN c_name ELSE c_name || ' ' || c_mktsegment END AS full_name, 'b' || c_custkey AS email FROM customer
""")
def user_profile_merge(spark: SparkSession, folder: str) -> DataFrame:
    """First and last name without blanks, none if both lack; the first matching element of an array."""
    first = F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))
    last = F.when(F.col("c_custkey") % 4 >= 2, F.col("c_mktsegment")).otherwise("")
    mails = F.array(F.struct(F.lit("a").alias("kind"), F.lit("x").alias("at")), F.struct(F.lit("primary").alias("kind"), F.concat(F.lit("b"), "c_custkey").alias("at")))
    mail = F.get(F.filter(mails, lambda m: m["kind"] == "primary"), F.lit(0))["at"]
    return table(spark, folder, "customer").select("c_custkey", F.nullif(joined(" ", first, last), F.lit("")).alias("full_name"), mail.alias("email"))


@query(r"""
SELECT doc_id, regexp_replace(string_split(chr(9) || chr(160) || ' ' || text, chr(10))[1], '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS first_line, CASE WHEN doc_id % 2 = 0 THEN source || '.' || doc_id ELSE doc_id::VARCHAR END AS qualified, source || ':' || doc_id || ':0' AS source_id FROM documents
""")
def symbol_labels(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("doc_id").cast("string")
    qualified = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("."), name)).otherwise(name)
    return table(spark, folder, "documents").select("doc_id", stripped(F.split(F.concat(F.lit("\t\u00a0 "), "text"), "\n", -1)[0]).alias("first_line"), qualified.alias("qualified"), F.concat_ws(":", "source", name, F.lit("0")).alias("source_id"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'No description' ELSE c_name END AS text, upper(c_mktsegment) AS segment, string_split(c_name, '#')[1] AS first_name FROM customer
""")
def default_text(spark: SparkSession, folder: str) -> DataFrame:
    """'' counts as missing."""
    raw = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    return table(spark, folder, "customer").select("c_custkey", F.coalesce(F.nullif(raw, F.lit("")), F.lit("No description")).alias("text"), F.upper("c_mktsegment").alias("segment"), F.split("c_name", "#", -1)[0].alias("first_name"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr') AND length(text) > 0 AND trim(text) <> '' AND source NOT LIKE 'src1%'")
def row_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Unknown languages, empty contents and blank messages give no rows."""
    languages = spark.createDataFrame([("en",), ("fr",)], "lang string")
    rows = table(spark, folder, "documents").filter((F.length("text") > 0) & (stripped(F.col("text")) != "") & ~F.col("source").startswith("src1"))
    return rows.join(F.broadcast(languages), "lang", "left_semi").select("doc_id", "lang")  # two rows


@query("""
SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' ELSE c_mktsegment END AS segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0
""")
def key_lookup_map(spark: SparkSession, folder: str) -> DataFrame:
    """External keys to names, a rename map with the old name as default, deleted users left out."""
    renames = F.create_map(F.lit("BUILDING"), F.lit("Construction"))
    customers, nations = table(spark, folder, "customer"), table(spark, folder, "nation")
    gone = customers.filter("c_custkey % 10 = 0").select("c_custkey")
    rows = customers.join(gone, "c_custkey", "left_anti").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce(F.try_element_at(renames, F.col("c_mktsegment")), F.col("c_mktsegment")).alias("segment"))


@query("""
WITH l AS (SELECT doc_id, i, list_extract(lines, i) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) t(i)),
m AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l WHERE length(line) < 40)
SELECT doc_id, CAST(min(i) AS INTEGER) AS first_line, count(*) AS lines FROM m GROUP BY doc_id, run
""")
def comment_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of neighbouring short lines, as comments above a symbol are found."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.length("line") < 40)
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.withColumn("run", run).groupBy("doc_id", "run").agg((F.min("pos") + 1).alias("first_line"), F.count(F.lit(1)).alias("lines")).select("doc_id", "first_line", "lines")


@query("""
SELECT doc_id, 'class' AS symbol_type, 'TypeScript' AS language, 'D' || doc_id AS qualified, true AS is_exported, CAST(1 AS INTEGER) AS start_line, CAST(5 AS INTEGER) AS end_line FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'method', 'TypeScript', 'D' || doc_id || '.go', true, 2, 4 FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'function', 'Python', 'f', false, 1, 3 FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'method', 'Go', 'Run', false, 2, 5 FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 'file', 'C++', 'src/' || doc_id || '.cpp', false, 1, 1 FROM documents WHERE doc_id % 4 = 3
""")
def code_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of sources in four languages, a comment and a decorator above them included; a file without symbols is one chunk."""
    from tessera.operators.chunking import split_large, symbol_chunks

    n, name = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    typescript = F.concat(F.lit("export class D"), name, F.lit(" extends Base {\n  go(x: string): string {\n    return `}${x}`; // }\n  }\n}\nlet n = 1;"))
    python = F.concat(F.lit("# about "), name, F.lit("\n@cached\ndef f(): return 1\n"))
    go = F.concat(F.lit("package x\n// Run about "), name, F.lit("\nfunc (r *R) Run() {\n\tx := map[string]int{}\n}\n"))
    content = F.when(n == 0, typescript).when(n == 1, python).when(n == 2, go).otherwise("int answer;")
    suffix = F.when(n == 0, ".ts").when(n == 1, ".py").when(n == 2, ".go").otherwise(".cpp")
    files = table(spark, folder, "documents").select(F.concat(F.lit("src/"), name, suffix).alias("path"), content.alias("content"))
    found = split_large(symbol_chunks(files))
    return found.select(F.regexp_extract("file_path", r"(\d+)", 1).cast("long").alias("doc_id"), "symbol_type", "language", F.col("qualified_name").alias("qualified"), "is_exported", "start_line", "end_line")


@query("""
WITH n AS (SELECT doc_id, doc_id % 120 + 150 AS body FROM documents), l AS (SELECT doc_id, body + 2 + 5 AS lines FROM n), p AS (SELECT doc_id, lines, CAST(CASE WHEN lines <= 200 THEN 1 ELSE ceil((lines - 200) / 190.0) + 1 END AS INTEGER) AS parts FROM l)
SELECT doc_id, CASE WHEN parts = 1 THEN 'big' ELSE 'big (part ' || i || '/' || parts || ')' END AS symbol, CASE WHEN parts > 1 THEN CAST(i AS INTEGER) END AS chunk_index, CAST(least(200, lines - 190 * (i - 1)) AS INTEGER) AS lines
FROM (SELECT *, unnest(range(1, parts + 1)) AS i FROM p)
""")
def code_chunks_split(spark: SparkSession, folder: str) -> DataFrame:
    """A symbol of more than 200 lines, its header counted, becomes overlapping parts."""
    from tessera.operators.chunking import split_large, symbol_chunks

    body = F.array_join(F.array_repeat(F.lit("  step();"), (F.col("doc_id") % 120 + 150).cast("int")), "\n")
    content = F.concat(F.lit("export function big() {\n"), body, F.lit("\n}"))
    files = table(spark, folder, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), content.alias("content"))
    parts = split_large(symbol_chunks(files))
    return parts.select(F.split("file_path", r"\.")[0].cast("long").alias("doc_id"), F.col("symbol_name").alias("symbol"), "chunk_index", F.size(F.split("content", "\n", -1)).alias("lines"))


@query("""
SELECT doc_id, k AS kind, n AS name, t AS target FROM documents, (VALUES ('import', './util', NULL, 0), ('import', 'react', NULL, 0), ('decorator', '@Injectable()', NULL, 0), ('inheritance', 'A', 'Base', 0), ('export', 'export class A extends Base {', NULL, 0),
  ('import', 'os', NULL, 1), ('import', '..pkg', 'thing', 1), ('decorator', 'B', 'wrap(1)', 1), ('inheritance', 'B', 'Base', 1), ('export', 'B', NULL, 1)) f(k, n, t, m) WHERE doc_id % 2 = m
""")
def code_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Imports, exports, decorators and inheritance of TypeScript and Python sources."""
    from tessera.operators.chunking import file_facts

    odd = F.col("doc_id") % 2 == 1
    typescript = "import { u } from './util';\nimport React from \"react\";\n// import no from 'where'\n@Injectable()\nexport class A extends Base {\n}\n"
    python = "import os\nfrom ..pkg import thing\n__all__ = ['B']\n@wrap(1)\nclass B(Base):\n    pass\n"
    files = table(spark, folder, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(odd, ".py").otherwise(".ts")).alias("path"), F.when(odd, python).otherwise(typescript).alias("content"))
    return file_facts(files).select(F.split("file_path", r"\.")[0].cast("long").alias("doc_id"), "kind", "name", "target")
