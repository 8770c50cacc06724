"""A data source for listings that come in pages, and retries with growing pauses.

The fetcher is any callable from a continuation token to (rows, next token), so the source runs offline in tests and with any client elsewhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers after which another try makes sense.
RETRY_STATUS = (429, 500, 502, 503, 504)


class StatusError(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def with_retries(call: Callable, tries: int = 6, sleep: Callable[[float], None] = time.sleep):
    """Calls until it succeeds; after retryable failures it waits 1, 2, 4, ... seconds."""
    for n in range(tries):
        try:
            return call()
        except StatusError as e:
            if e.status not in RETRY_STATUS or n == tries - 1:
                raise
            sleep(2**n)
    raise AssertionError


def pages(fetch: Callable[[str | None], tuple[list, str | None]], **retry) -> Iterator:
    """Rows of all pages, in order."""
    token = None
    while True:
        rows, token = with_retries(lambda: fetch(token), **retry)  # noqa: B023
        yield from rows
        if not token:
            return


class PagedSource(DataSource):
    """options: fetcher (module:function, called with the category and a token) and categories (comma-joined); one partition a category."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "category string, title string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetcher = options["fetcher"]
        self.categories = [c for c in options.get("categories", "").split(",") if c]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.categories]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), function)
        for title in pages(lambda token: fetch(partition.value, token)):
            yield partition.value, title
