"""Markdown texts as rows: fenced code with its language, headings, items, quotes and paragraphs, with their inline marks.

Lines are read one after the other. A fence opens on a line that begins with three or more backticks and closes on a line of at least as many and nothing else; a fence that
nothing closes is no fence, and its lines count as any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK = "position int, kind string, mark string, content string, code array<string>, bold array<string>, italic array<string>"
#: Bytes of text whose blocks are held at a time.
RUN_BYTES = 1 << 20


def fence_length(line: str) -> int:
    """How many backticks a line that may open or close a fence begins with; 0 if fewer than three."""
    n = len(line) - len(line.lstrip("`"))
    return n if n >= 3 else 0


def line_kind(line: str) -> tuple[str, str | None, str]:
    """(kind, mark, content) of a line outside of fences."""
    head, _, rest = line.partition(" ")
    if head in ("#", "##", "###") and rest:
        return "heading", head, rest.strip()
    if head in ("-", "*") and rest:
        return "item", head, rest.strip()
    if head[:-1].isdecimal() and head.endswith(".") and rest.strip():
        return "numbered", head[:-1], rest.strip()
    if head == ">" and rest:
        return "quote", head, rest.strip()
    return "paragraph", None, line


def inline_marks(text: str) -> tuple[list[str], list[str], list[str]]:
    """(code, bold, italic) of one line: what stands between equal marks, inner ones first. Marks within code are text, marks that nothing closes too; bold and italic may hold each other."""
    code, bold, italic = [], [], []
    open_: list[tuple[str, int]] = []
    i = 0
    while i < len(text):
        if text[i] == "`":
            end = text.find("`", i + 1)
            if end > i + 1:
                code.append(text[i + 1 : end])
                i = end + 1
                continue
        mark = "**" if text.startswith("**", i) else "*" if text[i] == "*" else ""
        if not mark:
            i += 1
            continue
        at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == mark), None)
        if at is not None and i > open_[at][1]:
            (bold if mark == "**" else italic).append(text[open_[at][1] : i])
            del open_[at:]
        else:
            open_.append((mark, i + len(mark)))
        i += len(mark)
    return code, bold, italic


def blocks(text: str) -> list[tuple]:
    """Blocks of a text. The mark is a fence's language ("code" if it names none), a heading's #, an item's bullet or number. Blank lines give no row."""
    lines, found, i = text.split("\n"), [], 0
    closers = [(k, fence_length(s)) for k, line in enumerate(lines) if (s := line.strip()) and not s.strip("`") and fence_length(s)]
    while i < len(lines):
        line = lines[i].strip()
        n = fence_length(line)
        end = next((k for k, size in closers if k > i and size >= n), None) if n and "`" not in line[n:] else None
        if end is not None:
            found.append((len(found), "fence", (line[n:].split() or ["code"])[0], "\n".join(lines[i + 1 : end]).rstrip(), [], [], []))
            i = end
        elif line:
            kind, mark, content = line_kind(line)
            found.append((len(found), kind, mark, content, *inline_marks(content)))
        i += 1
    return found


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about RUN_BYTES of text, one row at least."""
    first = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > first and size + n > RUN_BYTES:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if batch.num_rows > first:
        yield batch.slice(first)


def block_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of every document: the key, and BLOCK. Null texts give no row. Only the blocks of one short run of documents are held at a time."""
    strings = pa.list_(pa.string())
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), strings, strings, strings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(c.split()[0] for c in BLOCK.split(", "))]
        for batch in batches:
            for part in _runs(batch, 1):
                found = [blocks(t) for t in part.column(1).to_pylist()]
                of = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
                columns = zip(*(row for rows in found for row in rows), strict=True) if len(of) else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=names)

    rows = docs.select(key, text).dropna(subset=[text])
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {BLOCK}")
