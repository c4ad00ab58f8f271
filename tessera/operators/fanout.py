"""Calls from many tasks at once, and what they took."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.quantiles import exclusive_quantiles
from tessera.session import checkpoint_dir


def call_all(calls: DataFrame, spoke: str, argument: str, function: Callable[[str], object], spokes: int, threads: int = 16) -> DataFrame:
    """One row per call: spoke, argument, ok, result, error, seconds.

    Each task keeps ``threads`` calls going; a failed call is a row, not a failed task.  The rows are kept, so
    nothing that reads them calls again.
    """

    def one(a: str) -> tuple[bool, str | None, str | None, float]:
        t = time.perf_counter()
        try:
            return True, str(function(a)), None, time.perf_counter() - t
        except Exception as e:  # noqa: BLE001
            return False, None, f"{type(e).__name__}: {e}"[:500], time.perf_counter() - t

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in frames:
                done = list(pool.map(one, pdf["argument"]))
                out = pd.DataFrame(done, columns=["ok", "result", "error", "seconds"])
                yield pd.concat([pdf.reset_index(drop=True), out], axis=1)

    named = calls.select(F.col(spoke).cast("string").alias("spoke"), F.col(argument).cast("string").alias("argument"))
    checkpoint_dir(calls.sparkSession)
    return named.repartition(spokes).mapInPandas(run, "spoke string, argument string, ok boolean, result string, error string, seconds double").checkpoint()


def call_statistics(done: DataFrame) -> DataFrame:
    """Counts, longest and exclusive p50, p95 and p99 per spoke, and of all under ``(all)``."""
    both = done.withColumn("spoke", F.explode(F.array("spoke", F.lit("(all)"))))
    counted = both.groupBy("spoke").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.max("seconds").alias("longest"))
    return counted.join(exclusive_quantiles(both, "seconds", (0.5, 0.95, 0.99), ["spoke"]), "spoke")


def outcomes(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures, each in order."""
    return done.where("ok").orderBy("spoke", "argument"), done.where("NOT ok").orderBy("spoke", "argument")
