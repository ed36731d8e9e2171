"""A paged remote table as a Python data source: pages are partitions, one revision is read, tries are repeated with growing waits.

A caller gives a Pager: how many rows a revision has, and the rows of one page. `read_pages` keeps what it has read in a page log (a table
with a page number) in waves, so that a run which was stopped asks for the missing pages alone.

Defined results: a page that answers with another revision than the one asked for fails at once, since pages of two revisions do not
belong together; a page that answers with another number of rows than it has to is an error that is tried again; an empty
revision gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .staging import table_or_none


class RevisionChanged(Exception):
    """The rows are of another revision: trying again does not help."""


class Pager(Protocol):
    schema: str

    def size(self, revision: str) -> int: ...

    def page(self, revision: str, first: int, n: int) -> tuple[str, Sequence[tuple]]:
        """(the revision that answered, rows first ... first + n - 1)"""
        ...


class Page(InputPartition):
    def __init__(self, number: int, first: int, n: int):
        self.number, self.first, self.n = number, first, n


class PageReader(DataSourceReader):
    def __init__(self, pager: Pager, options: dict):
        self.pager, self.revision = pager, options["revision"]
        self.length, self.tries, self.wait = int(options.get("pagelength", 100)), int(options.get("tries", 4)), float(options.get("firstwait", 1))
        self.wanted = options.get("pages")

    def partitions(self) -> list[Page]:
        size = self.pager.size(self.revision)
        numbers = range(-(-size // self.length)) if self.wanted is None else [int(x) for x in self.wanted.split(",") if x]
        return [Page(i, i * self.length, min(self.length, size - i * self.length)) for i in numbers]

    def read(self, partition: Page) -> Iterator[tuple]:
        wait = self.wait
        for left in range(self.tries - 1, -1, -1):
            try:
                revision, rows = self.pager.page(self.revision, partition.first, partition.n)
                if revision != self.revision:
                    raise RevisionChanged(f"asked for {self.revision}, got {revision}")
                if len(rows) != partition.n:
                    raise OSError(f"page {partition.number} has {len(rows)} of {partition.n} rows")
                break
            except RevisionChanged:
                raise
            except Exception:
                if not left:
                    raise
                time.sleep(wait)
                wait *= 2
        for r in rows:
            yield (partition.number, *r)


def paged_source(pager: Pager, name: str = "paged") -> type[DataSource]:
    """A data source that can be registered; options: revision, pageLength, pages (numbers; all without it), tries, firstWait (seconds)."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"page int, {pager.schema}"

        def reader(self, schema) -> DataSourceReader:
            return PageReader(pager, {k.lower(): v for k, v in self.options.items()})

    return Paged


def read_pages(spark: SparkSession, pager: Pager, revision: str, log: str, length: int = 100, wave: int = 64, tries: int = 4, first_wait: float = 1.0, name: str = "paged") -> DataFrame:
    """All rows of a revision, from the page log at `log`; pages that it does not hold are read first, `wave` at a time."""
    spark.dataSource.register(paged_source(pager, name))
    at = f"{log}/{revision}-{length}"
    pages = -(-pager.size(revision) // length)
    held = table_or_none(spark, at)
    have = set() if held is None else {r.page for r in held.select("page").distinct().collect()}  # a number a page
    open_ = [i for i in range(pages) if i not in have]
    for i in range(0, len(open_), wave):
        now = ",".join(map(str, open_[i : i + wave]))
        source = spark.read.format(name).option("revision", revision).option("pageLength", length).option("pages", now).option("tries", tries).option("firstWait", first_wait)
        source.load().write.mode("append").parquet(at)
    out = table_or_none(spark, at)
    return spark.createDataFrame([], pager.schema) if out is None else out.where(F.col("page") < pages).drop("page")
