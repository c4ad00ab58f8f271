"""Incremental runs: new exports and new events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_documents(spark: SparkSession, folder: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """Rows of the parquet files that arrive in a folder, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Takes in what is new since the last run, batch by batch, and ends; a repeated batch comes with its old number."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def append_batches(target: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch into its own folder; a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and kind; events later than the watermark don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", "window.end", "event_type", "n", "value")
