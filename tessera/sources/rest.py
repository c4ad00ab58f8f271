"""Paged REST services as a Spark data source.

``spark.read.format("rest_pages")`` reads the pages of one or more addresses, each address a task.
Paging by offset, continuation link, next link or token; retries with backoff.  The
function that fetches is named as ``module:function`` so that executors can import it; the default uses urllib.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (status, headers, body) of a request.
Answer = tuple[int, dict, str]
# Answers worth another try, how often, and the longest wait in seconds.
AGAIN, TRIES, LONGEST = (408, 429, 500, 502, 503, 504), 5, 60.0


def fetch(url: str, headers: dict[str, str]) -> Answer:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as r:
            return r.status or 200, dict(r.headers), r.read().decode()  # a file has no status
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode("utf-8", "replace")


def stored(url: str, headers: dict[str, str]) -> Answer:
    """Answers that were stored as files of any file system that Arrow knows: a service to be replayed."""
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(url) if ":" in url else (fs.LocalFileSystem(), url)
    try:
        with at.open_input_stream(path) as f:
            return 200, {}, f.read().decode()
    except FileNotFoundError:
        return 404, {}, ""


def patient(get: Callable[[str, dict], Answer], url: str, headers: dict, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """An answer, asked for again while the service is busy: as long as it says, else twice as long each time."""
    for n in range(TRIES):
        status, said, body = get(url, headers)
        if status not in AGAIN or n == TRIES - 1:
            return status, said, body
        told = {k.lower(): v for k, v in said.items()}.get("retry-after")
        try:
            wait = float(told) if told is not None else 2.0**n
        except ValueError:
            wait = 2.0**n
        sleep(min(max(wait, 0.0), LONGEST))
    raise AssertionError("unreachable")


def _with(url: str, **more: object) -> str:
    parts = urllib.parse.urlsplit(url)
    query = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k not in more] + [(k, str(v)) for k, v in more.items()]
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))


def pages(get: Callable[[str, dict], Answer], url: str, headers: dict, paging: str = "link", size: int = 5000, sleep: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """The records of each page.

    ``offset`` asks with $top and $skip until a page is short; ``link`` follows continuationUri, nextLink or
    @odata.nextLink; ``token`` sends continuationToken again.  A page is a list, or an object with value or data.
    """
    skip, at, seen = 0, _with(url, **{"$top": size, "$skip": 0}) if paging == "offset" else url, set()
    while at and at not in seen:  # a service that repeats its own link doesn't loop
        seen.add(at)
        status, _, body = patient(get, at, headers, sleep)
        if status >= 400:
            raise OSError(f"{at} answered {status}: {body[:200]}")
        page = json.loads(body) if body else []
        rows = page if isinstance(page, list) else page.get("value") or page.get("data") or []
        yield rows
        if paging == "offset":
            skip += size
            at = _with(url, **{"$top": size, "$skip": skip}) if len(rows) >= size else None
        elif isinstance(page, list):
            at = None
        elif paging == "token":
            token = page.get("continuationToken")
            at = _with(url, continuationToken=token) if token else None
        else:
            at = page.get("continuationUri") or page.get("nextLink") or page.get("@odata.nextLink")


def poll(get: Callable[[str, dict], Answer], url: str, headers: dict, every: float = 2.0, most: int = 180, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The result of a long-running operation: asked until it is no longer accepted only, or too often."""
    for _ in range(most):
        status, said, body = patient(get, url, headers, sleep)
        state = json.loads(body).get("status", "") if body.startswith("{") else ""
        if status != 202 and state not in ("Running", "NotStarted"):
            return status, said, body
        sleep(every)
    raise TimeoutError(f"{url} was not done after {most} questions")


def first_filled(*sources: Callable[[], list]) -> list:
    """The records of the first source that has any; one that fails is passed over unless it is the last."""
    for n, source in enumerate(sources, 1):
        try:
            if rows := source():
                return rows
        except OSError:
            if n == len(sources):
                raise
    return []


class _Address(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[_Address]:
        return [_Address(u) for u in self.options["urls"].split("\n") if u.strip()]

    def read(self, partition: _Address) -> Iterator[tuple[str, int, str]]:
        module, _, name = self.options.get("fetcher", "tessera.sources.rest:fetch").partition(":")
        get = getattr(importlib.import_module(module), name)
        headers = json.loads(self.options.get("headers", "{}"))
        for n, rows in enumerate(pages(get, partition.url.strip(), headers, self.options.get("paging", "link"), int(self.options.get("size", 5000)))):
            for r in rows:
                yield partition.url.strip(), n, json.dumps(r)


class RestPages(DataSource):
    """Options: urls (one a line), paging (link, offset or token), size, headers (JSON), fetcher (module:function)."""

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "url string, page int, record string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestPages)
