"""A Python data source over paged HTTP endpoints, with retries; the transport is injected, so tests need no network.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("transport", "package.module:function").option("query", "...").load()

The transport is called with (query, page_token) and returns (status, headers,
body). Each query of the newline-separated ``query`` option is one partition.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Transport = Callable[[str, str | None], tuple[int, dict[str, str], str]]


class FetchError(RuntimeError):
    """A request that failed for good."""


def fetch(call: Transport, query: str, token: str | None, retries: int = 4, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page as an object; throttling and server errors are retried with growing waits, Retry-After is obeyed."""
    for attempt in range(retries + 1):
        status, headers, body = call(query, token)
        if status == 200:
            try:
                page = json.loads(body)
            except ValueError as error:
                raise FetchError("response is not JSON") from error
            if not isinstance(page, dict):
                raise FetchError("response is not an object")
            return page
        if status not in (429, 500, 502, 503, 504) or attempt == retries:
            raise FetchError(f"request failed with status {status}")
        wait = headers.get("Retry-After", "")
        sleep(float(wait) if wait.replace(".", "", 1).isdigit() else backoff * 2**attempt)
    raise FetchError("unreachable")


def pages(call: Transport, query: str, most: int = 10_000, **options: object) -> Iterator[dict]:
    """All pages of a query; a page token seen before, or more pages than allowed, raises."""
    token, seen = None, set()
    for _ in range(most):
        page = fetch(call, query, token, **options)
        yield page
        token = page.get("next_page_token")
        if not token:
            return
        if token in seen:
            raise FetchError("page token repeats")
        seen.add(token)
    raise FetchError(f"more than {most} pages")


@dataclass
class _Query(InputPartition):
    text: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[_Query]:
        return [_Query(q) for q in self.options["query"].split("\n") if q.strip()]

    def read(self, partition: _Query) -> Iterator[tuple]:
        module, name = self.options["transport"].split(":")
        call = getattr(importlib.import_module(module), name)
        for number, page in enumerate(pages(call, partition.text, int(self.options.get("maxpages", "10000")))):
            yield partition.text, number, json.dumps(page, sort_keys=True, ensure_ascii=False)


class PagedSource(DataSource):
    """Rows (query, page_number, page) of every page of every query."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query string, page_number int, page string"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)
