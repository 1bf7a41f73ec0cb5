"""Models from outside, as injected callables that go along with the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.schemas import parsed


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Writer(Protocol):
    def generate(self, prompt: str) -> str: ...


def embedded(rows: DataFrame, text: str, embedder: Embedder, into: str = "embedding") -> DataFrame:
    """`rows` with a vector of each text, one call per Arrow batch. Filter to new rows first: the call is the dear part."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(embedder.embed([t or "" for t in batch]))

    return rows.withColumn(into, run(F.col(text)))


def generated(prompt: Column, writer: Writer) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: writer.generate(p or ""))

    return run(prompt)


def structured(prompt: Column, writer: Writer, kind: str) -> Column:
    """What the writer says, read under the declared schema of `kind`; null where it is no such JSON."""
    return parsed(generated(prompt, writer), kind)
