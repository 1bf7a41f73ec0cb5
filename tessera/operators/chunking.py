"""Chunks of texts: overlapping line windows in SQL, a symbol chunker and file facts for seven languages.

Python is parsed with the standard library's ast, the others are cut into tokens (`lexing`) in which declarations are found (`scanning`).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.operators import scanning

MAX_LINES, OVERLAP = 200, 10


def line_windows(rows: DataFrame, text: str = "text", size: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """One row per window of `size` lines: part (from 1), parts, first_line, last_line, content.

    A text of at most `size` lines is one window; the last window ends with the text. Null texts give no row.
    """
    step = size - overlap
    lines = F.split(F.col(text), "\n", -1)
    n = F.size("_lines")
    parts = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    wide = rows.filter(F.col(text).isNotNull()).withColumn("_lines", lines).withColumn("parts", parts)
    out = wide.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    start = (F.col("part") - 1) * step + 1
    return (
        out.withColumn("first_line", start)
        .withColumn("last_line", F.least(start + size - 1, n))
        .withColumn("content", F.array_join(F.slice("_lines", start, F.lit(size)), "\n"))
        .drop("_lines")
    )


CHUNK = (
    "file_path string, language string, symbol_type string, symbol_name string, qualified_name string, parent_symbol string, "
    "is_exported boolean, docstring string, start_line int, end_line int, content string"
)
# The languages of file extensions, as chunk headers name them.
LANGUAGES = {".ts": "TypeScript", ".tsx": "TypeScript (React)", ".js": "JavaScript", ".jsx": "JavaScript (React)", ".py": "Python", ".go": "Go", ".cpp": "C++"}


def header(path: str, language: str, kind: str, name: str, exported: bool) -> str:
    # The lines of a chunk's header.
    lines = [f"// File: {path}", f"// Language: {language}", f"// Type: {kind}", f"// Name: {name}", "// Exported: true" if exported else ""]
    return "\n".join(x for x in lines if x)


def python_symbols(path: str, source: str) -> list[tuple]:
    """Chunk rows of one Python file; functions, methods (as functions without a parent) and classes, nested ones too, with the comments and decorators right above them."""
    lines = source.split("\n")
    found: list[tuple] = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                first = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                while first > 1 and lines[first - 2].lstrip().startswith("#"):
                    first -= 1
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                head = header(path, "Python", kind, child.name, False)
                body = "\n".join(lines[first - 1 : child.end_lineno])
                found.append((path, "Python", kind, child.name, child.name, None, False, ast.get_docstring(child), first, child.end_lineno, f"{head}\n{body}".strip()))
            visit(child)

    visit(ast.parse(source))
    return found


def scanned_symbols(path: str, language: str, source: str) -> list[tuple]:
    """Chunk rows of one file of another language."""
    lines, found = source.split("\n"), []
    for kind, name, parent, exported, docstring, first, last in scanning.symbols(language, source):
        full = f"{parent}.{name}" if parent else name
        text = f"{header(path, language, kind, full, exported)}\n" + "\n".join(lines[first : last + 1])
        found.append((path, language, kind, name, full, parent, exported, docstring, first + 1, last + 1, text.strip()))
    return found


@udtf(returnType=f"{CHUNK}, error string")
class SymbolChunks:
    """Table function (path, language, content) -> the chunks of one file. A file that can't be read gives one chunk, of kind file, and says why in `error`."""

    def eval(self, path: str, language: str, content: str) -> Iterator[tuple]:
        error, rows = None, []
        try:
            rows = python_symbols(path, content) if language == "Python" else scanned_symbols(path, language, content)
        except (SyntaxError, ValueError, RecursionError) as e:  # a broken file must not end the job
            error = f"{type(e).__name__}: {e.args[0] if e.args else ''}"
        if rows:
            yield from ((*row, None) for row in rows)
        else:
            text = f"// File: {path}\n// Language: {language}\n{content}".strip()
            yield path, language, "file", path.rpartition("/")[2], path, None, False, None, 1, content.count("\n") + 1, text, error


def chunk_report(files: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Chunks of (path, content) and `error`: symbols of files of known languages, one whole-file chunk for files without symbols or that can't be read, which says why.

    Unknown extensions and empty contents give no rows. `observation` gets the numbers of chunks, files and failures once the rows were made, without another pass.
    """
    from tessera.functions.text import extension

    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    known = files.select(F.col("path").alias("_path"), F.try_element_at(table, extension(F.col("path"))).alias("_language"), F.col("content").alias("_content"))
    known = known.filter("_language is not null and length(_content) > 0")
    chunks = known.lateralJoin(SymbolChunks(F.col("_path").outer(), F.col("_language").outer(), F.col("_content").outer())).drop("_path", "_language", "_content")
    if observation is not None:
        chunks = chunks.observe(observation, F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("symbol_type") == "file").alias("whole_files"), F.count("error").alias("failures"))
    return chunks.withColumn("content_hash", F.sha2("content", 256))


def symbol_chunks(files: DataFrame) -> DataFrame:
    """`chunk_report` without errors. `split_large` cuts long chunks."""
    return chunk_report(files).drop("error")


def file_outlines(chunks: DataFrame) -> DataFrame:
    """(file_path, classes, interfaces, functions): names by kind, in the order of the file; functions and methods by their qualified names. One row per file, as long as its chunks are."""
    of = lambda kinds, name: F.transform(F.filter("x", lambda r: r["symbol_type"].isin(*kinds)), lambda r: r[name])
    rows = chunks.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "symbol_type", "symbol_name", "qualified_name"))).alias("x"))
    return rows.select("file_path", of(["class"], "symbol_name").alias("classes"), of(["interface"], "symbol_name").alias("interfaces"), of(["function", "method"], "qualified_name").alias("functions"))


def split_large(chunks: DataFrame, size: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """`symbol_chunks` with every chunk of more than `size` lines, header included, as overlapping windows.

    chunk_index and chunk_total are null for chunks that stay whole. Line numbers are those of the source, without the header.
    """
    header = F.when(F.col("symbol_type") == "file", 2).otherwise(4 + F.col("is_exported").cast("int"))
    parts = line_windows(chunks, "content", size, overlap)
    cut = F.col("parts") > 1
    start = F.col("start_line") + F.greatest(F.lit(0), F.col("first_line") - 1 - header)
    end = F.least("end_line", F.col("start_line") + F.greatest(F.lit(0), F.col("last_line") - 1 - header))
    return (
        parts.withColumns({"_start": F.when(cut, start).otherwise(F.col("start_line")), "_end": F.when(cut, end).otherwise(F.col("end_line"))})
        .withColumn("symbol_name", F.when(cut, F.format_string("%s (part %d/%d)", "symbol_name", "part", "parts")).otherwise(F.col("symbol_name")))
        .withColumns({"chunk_index": F.when(cut, F.col("part")), "chunk_total": F.when(cut, F.col("parts")), "content_hash": F.sha2("content", 256)})
        .drop("start_line", "end_line", "part", "parts", "first_line", "last_line")
        .withColumnsRenamed({"_start": "start_line", "_end": "end_line"})
    )


FACT = "file_path string, kind string, name string, target string"


def python_facts(path: str, source: str) -> list[tuple]:
    """Distinct (path, kind, name, target): imports (module, name taken from it), exports (entries of a literal __all__),
    decorators (what they decorate, the decorator) and inheritance (class, base)."""
    found: dict[tuple, None] = {}
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            found |= dict.fromkeys((path, "import", x.name, None) for x in node.names)
        elif isinstance(node, ast.ImportFrom):
            found |= dict.fromkeys((path, "import", "." * node.level + (node.module or ""), x.name) for x in node.names)
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, ast.List | ast.Tuple):
            found |= dict.fromkeys((path, "export", x.value, None) for x in node.value.elts if isinstance(x, ast.Constant))
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            found |= dict.fromkeys((path, "decorator", node.name, ast.unparse(d)) for d in node.decorator_list)
        if isinstance(node, ast.ClassDef):
            found |= dict.fromkeys((path, "inheritance", node.name, ast.unparse(b)) for b in node.bases)
    return list(found)


def file_facts(files: DataFrame) -> DataFrame:
    """Imports, exports, decorators and inheritance of (path, content) files. Files that don't parse, Go, C++ and unknown languages give no rows."""
    from tessera.functions.text import extension

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"], strict=True):
                try:
                    out += python_facts(path, content) if language == "Python" else [(path, *fact) for fact in scanning.facts(language, content)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FACT.split(", ")])

    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    known = files.withColumn("language", F.try_element_at(table, extension(F.col("path")))).filter("language is not null and content is not null")
    return known.select("path", "language", "content").mapInPandas(run, FACT)
