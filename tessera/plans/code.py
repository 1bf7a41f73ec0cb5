"""Code structure over sources that are made from whole texts: each line of a text becomes a declaration, or a part of one that must not be taken for code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, structure
from tessera.plans.registry import query
from tessera.sources.tables import table

#: Shapes of declarations; K is the line's number. RAW is the line, in comments; QUOTED, TICKED and STARRED are the line without the marks that would end a string, a template or a comment.
SHAPES = [
    "// RAW\nexport function fK(a: string, b = { x: 1 }): void {\n}",
    'export const fK = async (\n  a: string,\n): Promise<Map<string, { b: number }>> => {\n  return `TICKED${a ? `}` : "{"}`;\n};',
    "class CK<T extends { a: 1 }> extends B<T> {\n  runK(x = /[}/]{1,2}/): void { if (x) { } }\n  getK = (y) => y;\n}",
    "interface IK { a: string; m(): { b: 1 } }",
    'type TK =\n  | "QUOTED"\n  | { a: () => void };',
    'export enum EK { A = "QUOTED", B }',
    'const fK = function () { return "QUOTED"; }, gK = x => x * 2;',
    "let nK = a / 2 / c; /* STARRED { */",
    "const oK = { mK(a) { return `TICKED`; }, p: 1 };",
    '@dec({ a: "(" })\nexport abstract class CK {\n  @log() private static async *goK<A>(a: A): AsyncGenerator<A> { yield a; }\n  sig(): void;\n  #pK = async () => { };\n}',
    "function fK(a: string): void;\nfunction fK(a: any) { return a < 1 && a > 2; }",
    "export { xK } from './x'; // RAW",
]
#: (shape, kind, name, parent, exported, first line, last line) of what each shape declares.
DECLARED = [
    (0, "function", "f", None, True, 0, 2), (1, "function", "f", None, True, 0, 4), (2, "class", "C", None, False, 0, 3), (2, "method", "run", "C", False, 1, 1), (2, "method", "get", "C", False, 2, 2),
    (3, "interface", "I", None, False, 0, 0), (4, "type", "T", None, False, 0, 2), (5, "enum", "E", None, True, 0, 0), (6, "function", "f", None, False, 0, 0), (6, "function", "g", None, False, 0, 0),
    (8, "method", "m", None, False, 0, 0), (9, "class", "C", None, True, 0, 5), (9, "method", "go", "C", True, 2, 2), (9, "method", "#p", "C", True, 4, 4), (10, "function", "f", None, False, 1, 1),
]
BROKEN = {3: "\nconst t = `", 7: "\nf(("}


def _literal(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


SYMBOLS = f"""
WITH shapes(t, size) AS (VALUES {", ".join(f"({i}, {s.count(chr(10)) + 1})" for i, s in enumerate(SHAPES))}),
declared(t, kind, name, parent, exported, a, b) AS (VALUES {", ".join("(" + ", ".join(map(_literal, d)) + ")" for d in DECLARED)}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
placed AS (SELECT doc_id, k, t, sum(size) OVER (PARTITION BY doc_id ORDER BY k) - size + 1 AS first FROM (SELECT doc_id, k, (length(line) + k) % {len(SHAPES)} AS t FROM lines) JOIN shapes USING (t)),
found AS (SELECT doc_id, kind, coalesce(parent || k || '.', '') || name || k AS qualified, name || k AS name, exported, first + a AS start_line, first + b AS end_line FROM placed JOIN declared USING (t) WHERE doc_id % 10 NOT IN (3, 7)),
whole AS (SELECT doc_id, sum(size) + CASE WHEN doc_id % 10 IN (3, 7) THEN 1 ELSE 0 END AS lines FROM placed JOIN shapes USING (t) GROUP BY doc_id)
"""


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, content): one TypeScript file per document; those whose ids end in 3 or 7 break off in a template or a bracket."""
    marks = {"QUOTED": [("\\", "/"), ('"', "'")], "TICKED": [("\\", "/"), ("`", "'"), ("$", "S")], "STARRED": [("*", "+")], "RAW": []}

    def declaration(line: Column, k: Column) -> Column:
        shape, out = ((F.length(line) + k) % len(SHAPES)).cast("int"), None
        for i, text in enumerate(SHAPES):
            filled: Column = F.replace(F.lit(text), F.lit("K"), k.cast("string"))
            for mark, swaps in marks.items():
                if mark in text:
                    safe = line
                    for old, new in swaps:
                        safe = F.replace(safe, F.lit(old), F.lit(new))
                    filled = F.concat(*[c for j, part in enumerate(text.split(mark)) for c in ([safe] if j else []) + [F.replace(F.lit(part), F.lit("K"), k.cast("string"))]])
            out = F.when(shape == i, filled) if out is None else out.when(shape == i, filled)
        return out

    whole = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), declaration), "\n")
    end = F.lit("")
    for digit, text in BROKEN.items():
        end = F.when(F.col("doc_id") % 10 == digit, text).otherwise(end)
    return table(spark, folder, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.concat(whole, end).alias("content"))


@query(f"""{SYMBOLS} SELECT doc_id, kind, qualified, exported, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM found
UNION ALL SELECT doc_id, 'file', doc_id || '.ts', false, 1, CAST(lines AS BIGINT) FROM whole WHERE doc_id NOT IN (SELECT doc_id FROM found)
""")
def code_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Every declaration of every source with its lines; broken sources and those without declarations are one chunk."""
    rows = chunking.symbol_chunks(sources(spark, folder).select("path", "content"))
    doc = F.split("file_path", r"\.")[0].cast("long").alias("doc_id")
    return rows.select(doc, F.col("symbol_type").alias("kind"), F.col("qualified_name").alias("qualified"), F.col("is_exported").alias("exported"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"""{SYMBOLS}, all_chunks AS (SELECT doc_id, kind, NULL AS error FROM found
UNION ALL SELECT doc_id, 'file', CASE doc_id % 10 WHEN 3 THEN 'LexingError: a template that does not end' WHEN 7 THEN 'LexingError: a ( that does not close' END FROM whole WHERE doc_id NOT IN (SELECT doc_id FROM found))
SELECT kind, error, count(*) AS chunks, count(DISTINCT doc_id) AS files FROM all_chunks GROUP BY kind, error
""")
def chunk_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and files by kind, failures by what was wrong."""
    rows = chunking.chunk_report(sources(spark, folder).select("path", "content"))
    return rows.groupBy(F.col("symbol_type").alias("kind"), "error").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_path").alias("files"))


@query(f"""{SYMBOLS}, of AS (SELECT doc_id, string_agg(name, ',' ORDER BY start_line, end_line, name) FILTER (WHERE kind = 'class') AS classes, string_agg(name, ',' ORDER BY start_line, end_line, name) FILTER (WHERE kind = 'interface') AS interfaces,
  string_agg(qualified, ',' ORDER BY start_line, end_line, kind, name) FILTER (WHERE kind IN ('function', 'method')) AS functions FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(classes, '') AS classes, coalesce(interfaces, '') AS interfaces, coalesce(functions, '') AS functions FROM whole LEFT JOIN of USING (doc_id)
""")
def file_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of each file by kind."""
    rows = chunking.file_outlines(chunking.symbol_chunks(sources(spark, folder).select("path", "content")))
    return rows.select(F.split("file_path", r"\.")[0].cast("long").alias("doc_id"), *[F.array_join(c, ",").alias(c) for c in ("classes", "interfaces", "functions")])


@query("""
WITH said AS (
  SELECT doc_id AS src, source AS target_source, doc_id + 1 AS dst FROM documents UNION ALL SELECT doc_id, 'src' || doc_id * 7 % 20, doc_id * 7 % 1000 FROM documents UNION ALL SELECT doc_id, 'src' || (doc_id + 17) % 20, doc_id - 3 FROM documents
), edges AS (
  SELECT DISTINCT s.src, a.source AS module, s.dst, d.source AS target FROM said s JOIN documents a ON a.doc_id = s.src JOIN documents d ON d.doc_id = s.dst AND d.source = s.target_source
) SELECT module, target, count(*) AS edges FROM edges WHERE module <> target GROUP BY module, target
""")
def import_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Imports between files as their statements say, over lines and beside comments and strings that look alike; edges between sources are counted."""
    n, line = F.col("doc_id"), F.replace(F.coalesce("text", F.lit("")), F.lit("*"), F.lit("+"))
    content = F.concat(
        F.lit("import {\n  a,\n  type B,\n} from './"), n + 1, F.lit("';\n/* import x from './"), n + 2, F.lit("';\n"), line, F.lit(" */ import * as c from \"../src"), n * 7 % 20, F.lit("/"), n * 7 % 1000,
        F.lit("\"\nconst s = `\nimport './"), n + 4, F.lit("'`;\nimport '../src"), (n + 17) % 20, F.lit("/"), n - 3, F.lit(".ts'; import react from 'react'; export { d } from './"), n + 5, F.lit("';\n"),
    )
    files = table(spark, folder, "documents").select(F.concat(F.lit("app/"), "source", F.lit("/"), n, F.lit(".ts")).alias("path"), content.alias("content"))
    return structure.cross_edges(structure.file_edges(files), files.select("path", F.element_at(F.split("path", "/"), 2).alias("module")))
