"""Frames of an event stream, put together again from reads that were cut anywhere.

A session's reads are bytes with a number from 0. State carries what follows the last whole frame, so a frame, a character or a frame's end may lie across
any number of reads; reads that arrive early wait for those before them. What the last read leaves is a frame too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.state import with_stores

READS = "session string, read long, body binary, last boolean"
FRAMES = "session string, position long, kind string, data string"
# The kinds of frames.
KINDS = ("sessionId", "sources", "metadata", "text")
_END = re.compile(rb"\r?\n\r?\n")


def cut(held: bytes) -> tuple[list[bytes], bytes]:
    """(whole frames, what follows them). A carriage return at the very end may belong to a frame's end and waits."""
    *whole, rest = _END.split(held)
    return whole, rest


def frame(raw: bytes) -> tuple[str, str] | None:
    """(kind, data) of one frame: its data lines joined, read as JSON {type, data}; text as it is, other data as JSON. None for comments and blanks; ("malformed", what it said) if it can't be read."""
    said = [line[5:].removeprefix(b" ") for line in re.split(rb"\r?\n", raw) if line.startswith(b"data:")]
    if not said:
        return None
    text = b"\n".join(said).decode("utf-8", "replace")
    try:
        payload = json.loads(text)
    except ValueError:
        return "malformed", text
    if not isinstance(payload, dict) or payload.get("type") not in KINDS or "data" not in payload:
        return "malformed", text
    data = payload["data"]
    return payload["type"], data if isinstance(data, str) else json.dumps(data, ensure_ascii=False, separators=(",", ":"))


class Frames(StatefulProcessor):
    """State of a session: the next read, the next frame's position and the unfinished bytes; and reads that came early."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, position long, rest binary")
        self.early = handle.getMapState("early", "read long", "body binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        at, position, rest = self.state.get() if self.state.exists() else (0, 0, b"")
        rest = bytes(rest)
        waiting: dict[int, tuple[bytes, bool]] = {}
        for pdf in rows:
            for read, body, last in zip(pdf["read"], pdf["body"], pdf["last"], strict=True):
                if read >= at:  # a read that comes again says nothing
                    waiting.setdefault(int(read), (bytes(body) if body is not None else b"", bool(last)))
            found: list[tuple[str, str]] = []
            while at in waiting or self.early.containsKey((at,)):
                if at in waiting:
                    body, last = waiting.pop(at)
                else:
                    body, last = self.early.getValue((at,))
                    self.early.removeKey((at,))
                whole, rest = cut(rest + bytes(body))
                if last:
                    whole, rest = [*whole, rest], b""
                found += [f for raw in whole if (f := frame(raw))]
                at += 1
            if found:
                yield pd.DataFrame({"session": key[0], "position": range(position, position + len(found)), "kind": [k for k, _ in found], "data": [d for _, d in found]})
                position += len(found)
        for read, value in waiting.items():
            self.early.updateValue((read,), value)
        self.state.update((at, position, rest))

    def close(self) -> None:
        pass


def frames(reads: DataFrame) -> DataFrame:
    """FRAMES of READS, a table or a stream (append mode, started within `keyed_state`); positions count a session's frames from 0. Rows without session or read number are left out, null bodies are empty."""
    with_stores(reads.sparkSession)
    known = reads.select("session", "read", "body", "last").filter("session is not null and read is not null")
    return known.groupBy("session").transformWithStateInPandas(Frames(), FRAMES, "Append", "None")
