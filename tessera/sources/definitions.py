"""Definitions of items, asked for one by one from many tasks.

A service may answer at once, ask to come back (long-running operation), be busy, or have let the token expire; what became
of every item is a row, never a failed task.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir
from tessera.sources.rest import AGAIN, LONGEST, TRIES, Answer

#: (method, address, headers) to an answer.
Call = Callable[[str, str, dict], Answer]
# Seconds between two questions about an operation, and how many are asked.
EVERY, QUESTIONS = 2.0, 180
OUTCOME = "body string, http_status int, attempts int, token_refreshes int, fetch_error string"


def call(method: str, url: str, headers: dict) -> Answer:
    """One request by urllib."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=b"" if method == "POST" else None, headers=headers, method=method), timeout=60) as r:
            return r.status or 200, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode("utf-8", "replace")


@dataclass
class Exchange:
    """The questions about one item: counts attempts and renewed tokens, waits while the service is busy."""

    ask: Call
    headers: dict
    renew: Callable[[], dict] | None = None
    sleep: Callable[[float], None] = time.sleep
    attempts: int = 0
    refreshes: int = 0
    status: int = field(default=0)

    def send(self, method: str, url: str) -> Answer:
        """An answer that is final for this address: neither busy nor, where the token can be renewed, unauthorized."""
        for n in range(TRIES):
            self.attempts += method == "POST"
            self.status, said, body = self.ask(method, url, self.headers)
            last = n == TRIES - 1
            if self.status == 401 and self.renew and not last:
                self.headers, self.refreshes = self.renew(), self.refreshes + 1
            elif self.status in AGAIN and not last:
                told = _header(said, "retry-after")
                self.sleep(min(float(told) if told and told.replace(".", "", 1).isdigit() else 2.0**n, LONGEST))
            else:
                return self.status, said, body
        raise AssertionError("unreachable")

    def finished(self, url: str) -> tuple[str | None, str | None]:
        """Body or error of an accepted operation, asked for until it is done."""
        for _ in range(QUESTIONS):
            self.sleep(EVERY)
            status, _, body = self.send("GET", url)
            state = json.loads(body).get("status") if status == 200 and body[:1] == "{" else None
            if state == "Succeeded":
                status, _, body = self.send("GET", f"{url}/result")
                return (body, None) if status == 200 else (None, f"result answered {status}")
            if state == "Failed" or status >= 400:
                return None, f"operation failed: {body[:300]}"
        return None, f"not done after {QUESTIONS} questions"


def _header(said: dict, name: str) -> str | None:
    return {k.lower(): v for k, v in said.items()}.get(name)


def definition(exchange: Exchange, url: str, operations: str = "") -> tuple[str | None, int, int, int, str | None]:
    """(body, status, attempts, renewed tokens, error) of one definition; exactly one of body and error is NULL."""
    try:
        status, said, body = exchange.send("POST", url)
        error = None
        if status == 202:
            number = _header(said, "x-ms-operation-id")
            at = _header(said, "location") or (f"{operations}/{number}" if number else None)
            body, error = exchange.finished(at) if at else (None, "accepted without a place to ask")
        elif status != 200:
            body, error = None, body[:300] or f"answered {status}"
    except Exception as e:  # noqa: BLE001  a lost connection is the item's outcome
        body, error = None, f"{type(e).__name__}: {e}"[:300]
    return body, exchange.status, exchange.attempts, exchange.refreshes, error


def _named(path: str | None):
    module, _, name = (path or "").partition(":")
    return getattr(importlib.import_module(module), name) if path else None


def fetched_definitions(items: DataFrame, url: str, caller: str = "tessera.sources.definitions:call", headers: dict | None = None, renewer: str | None = None, operations: str = "", tasks: int = 8, threads: int = 16, wait: bool = True) -> DataFrame:
    """The items with body, http_status, attempts, token_refreshes and fetch_error of their definitions.

    ``url`` names the column with each item's address; ``caller`` and ``renewer`` (which gives new headers) are named as module:function so that
    executors import them.  Each task keeps ``threads`` requests going.  The rows are kept in the checkpoint folder, so no later step asks again.
    A NULL address is an error row.
    """
    ask, renew, sleep = _named(caller), _named(renewer), time.sleep if wait else (lambda _: None)
    named = [f.name for f in items.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + f", {OUTCOME}"

    def one(at: str | None) -> tuple:
        return definition(Exchange(ask, dict(headers or {}), renew, sleep), at, operations) if at else (None, 0, 0, 0, "no address")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in frames:
                got = pd.DataFrame(list(pool.map(one, pdf[url])), columns=[c.split()[0] for c in OUTCOME.split(", ")])
                yield pd.concat([pdf.reset_index(drop=True), got], axis=1)

    checkpoint_dir(items.sparkSession)
    return items.select(*named).repartition(tasks).mapInPandas(run, schema).checkpoint()


def scanned_in_batches(ids: DataFrame, id_: str, size: int = 100) -> DataFrame:
    """The ids in batches of at most ``size`` for a service that scans so many at once: batch and ids, in order.

    Ids are dealt by ranges, and numbered within their range, so no task sees all of them.
    """
    from pyspark.sql import Window

    spread = ids.select(F.col(id_).alias("id")).where("id IS NOT NULL").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id())
    n = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return spread.withColumn("number", F.floor(n / size)).groupBy("part", "number").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.concat_ws("-", "part", "number").alias("batch"), "ids")
