"""Declared constraints, checked over a whole table: every row with the names of those it breaks, or the good rows and the rest apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A condition that no row may make false; null passes."""

    name: str
    condition: str


@dataclass(frozen=True)
class Required:
    """A column that may not be null."""

    name: str
    column: str


@dataclass(frozen=True)
class Unique:
    """At most one row per values of `columns` among those that `where` takes in; null equals nothing. The first by `order` stays, the others break it; rows that repeat as a whole are one too many each but not told apart, so give them an id."""

    name: str
    columns: tuple[str, ...]
    order: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Reference:
    """Values of `column` must be among `key` of `table`; null passes."""

    name: str
    column: str
    table: DataFrame
    key: str


def checked(rows: DataFrame, constraints: list, into: str = "violated") -> DataFrame:
    """`rows` with `into`: the names of the constraints that a row breaks, in their order.

    Checks cost no shuffle. A uniqueness is one aggregation to the values that repeat, and a join to those; a reference is a join to the distinct keys. All other columns stay; `into` must have a name of its own.
    """
    out, broken, spare = rows, [], []
    for i, c in enumerate(constraints):
        mark = f"{into}_{i}"
        if isinstance(c, Check):
            broken.append(F.when(~F.expr(c.condition), c.name))
        elif isinstance(c, Required):
            broken.append(F.when(F.col(c.column).isNull(), c.name))
        elif isinstance(c, Unique):
            whole: Column = F.expr(c.where)
            for column in c.columns:
                whole = whole & F.col(column).isNotNull()
            keys = [f"{mark}_{j}" for j in range(len(c.columns))]
            firsts = rows.filter(whole).groupBy(*[F.col(a).alias(b) for a, b in zip(c.columns, keys, strict=True)]).agg(F.min(F.struct(*c.order)).alias(mark), F.count(F.lit(1)).alias(f"{mark}_n")).filter(F.col(f"{mark}_n") > 1)
            on = whole
            for a, b in zip(c.columns, keys, strict=True):
                on = on & (F.col(a) == F.col(b))
            out = out.join(firsts, on, "left")
            broken.append(F.when(F.col(mark).isNotNull() & (F.struct(*c.order) > F.col(mark)), c.name))
            spare += [mark, f"{mark}_n", *keys]
        elif isinstance(c, Reference):
            known = c.table.select(F.col(c.key).alias(mark)).filter(F.col(mark).isNotNull()).distinct()
            out = out.join(known, F.col(c.column) == F.col(mark), "left")
            broken.append(F.when(F.col(c.column).isNotNull() & F.col(mark).isNull(), c.name))
            spare.append(mark)
    return out.withColumn(into, F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")).drop(*spare)


def violations(rows: DataFrame, constraints: list, into: str = "violated") -> DataFrame:
    """One row per row and constraint that it breaks."""
    return checked(rows, constraints, into).withColumn(into, F.explode(into))


def quarantined(rows: DataFrame, constraints: list, into: str = "violated") -> tuple[DataFrame, DataFrame]:
    """(rows that break nothing, the others with what they break)."""
    out = checked(rows, constraints, into)
    return out.filter(F.size(into) == 0).drop(into), out.filter(F.size(into) > 0)
