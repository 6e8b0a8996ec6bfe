"""Dated pages as a data source: one partition for each date or run of dates, and a page that fails is an error, not an empty day."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsloom.session import ship

SCHEMA = "date string, url string, html string, error string"
#: Tasks up to which each date has its own; dates that one may read.
TASKS, RUN = 1_000, 1_000


def fetch(url: str, timeout: float) -> str:
    """The text of a page by HTTP, from a file, or from a store that Arrow opens."""
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(url, timeout=timeout) as reply:  # raises on error replies
            return reply.read().decode(reply.headers.get_content_charset() or "utf-8")
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(url)
    with fs.open_input_stream(path) as f:
        return f.read().decode()


def compact(day: np.datetime64) -> str:
    """A date as yyyymmdd, years before 0 with a sign; not bounded by the years of :mod:`datetime`."""
    year, month, date = str(day).rsplit("-", 2)
    return f"{int(year)}{month}{date}" if year.startswith("-") else f"{int(year):04d}{month}{date}"


class Days(InputPartition):
    def __init__(self, first: int, after: int):
        super().__init__((first, after))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.template, self.end = options["path"], np.datetime64(options["end"], "D")
        self.days, self.timeout, self.tries = int(options.get("days", 1)), float(options.get("timeout", 30)), int(options.get("tries", 1))
        self.errors = options.get("errors", "fail")
        if "{date}" not in self.template or self.days < 1 or self.tries < 1 or self.errors not in ("fail", "keep"):
            raise ValueError("path needs {date}, days and tries must be positive, errors is fail or keep")

    def partitions(self) -> list[InputPartition]:
        run = min(-(-self.days // TASKS), RUN)
        return [Days(i, min(i + run, self.days)) for i in range(0, self.days, run)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(*partition.value):
            yield self.page(compact(self.end - i))

    def page(self, date: str) -> tuple:
        url = self.template.replace("{date}", date)
        for left in reversed(range(self.tries)):
            try:
                return date, url, fetch(url, self.timeout), None
            except (OSError, ValueError) as e:  # no page, no reply, no text in its encoding
                if left:
                    continue
                if self.errors == "fail":
                    raise RuntimeError(f"page of {date}: {e}") from e
                return date, url, None, f"{type(e).__name__}: {e}"
        raise ValueError("tries must be positive")


class DatedPages(DataSource):
    """``spark.read.format("dated_pages")`` with options ``path`` (a URL that holds ``{date}``), ``end`` (a date), ``days``, ``timeout``, ``tries`` and ``errors`` (fail, or keep: a row with the error)."""

    @classmethod
    def name(cls) -> str:
        return "dated_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


def read_pages(spark: SparkSession, path: str, end: str, days: int = 1, errors: str = "fail", tries: int = 1, timeout: float = 30) -> DataFrame:
    """``date, url, html, error`` of the pages of the last days up to ``end``, fetched a date in each task, or a run of dates where there are more than ``TASKS``."""
    ship(spark)
    spark.dataSource.register(DatedPages)
    return spark.read.format("dated_pages").options(path=path, end=end, days=days, errors=errors, tries=tries, timeout=timeout).load()
