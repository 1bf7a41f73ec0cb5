"""A paged listing as a data source: one partition per page, equality filters handed to the listing, no more pages than a limit needs.

How a page is fetched is injected: `fetch(number, wanted)` gives the rows of page `number` (from 1) that meet `wanted`, {column: value} of the filters handed down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

Fetch = Callable[[int, dict], list[dict]]


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PageReader(DataSourceReader):
    def __init__(self, fetch: Fetch, names: list[str], pages: int, handed: frozenset[str]):
        self.fetch, self.names, self.pages, self.handed, self.wanted = fetch, names, pages, handed, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equalities on columns that the listing filters by are its work, all others Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.handed and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(n + 1) for n in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in self.fetch(partition.number, self.wanted):
            yield tuple(row.get(n) for n in self.names)


def read_pages(spark: SparkSession, fetch: Fetch, schema: str, pages: int, handed: set[str] = frozenset(), limit: int | None = None, per_page: int = 100, name: str = "pages") -> DataFrame:
    """The rows of a listing of `pages` pages; with a `limit`, of the first pages that can hold as many, cut to it.

    `handed`: columns that the listing itself can filter by. A limit is for listings that come in order and are not filtered afterwards, as a page's rows that Spark filters out are not replaced.
    """
    wanted = pages if limit is None else min(pages, -(-limit // per_page))

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return PageReader(fetch, schema.names, wanted, frozenset(handed))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
    rows = spark.read.format(name).load()
    return rows if limit is None else rows.limit(limit)
