"""Where results go: tables, folders, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.latest import upsert_path


def _write(df: DataFrame, target: str, mode: str, partition: str | None = None, **options: str) -> None:
    w = df.write.mode(mode).options(**options)
    if partition:
        w = w.partitionBy(partition)
    w.parquet(target) if "/" in target else w.saveAsTable(target)


def overwrite(df: DataFrame, target: str) -> None:
    """Replaces a table (by name) or a folder (by path), schema included."""
    _write(df, target, "overwrite", overwriteSchema="true")


def append(df: DataFrame, target: str, partition: str | None = "run_label") -> None:
    """Appends a run; a folder is laid out by run, so a later read of one run reads only that."""
    _write(df, target, "append", partition if partition in df.columns else None, mergeSchema="true")


def read_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All runs of an appended folder; columns that came later are NULL in earlier runs.  With a ``schema`` no file is opened to learn it, and a folder without rows is an empty table."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", "true").parquet(path)


def ensure(spark: SparkSession, tables: dict[str, tuple[str, str]], root: str) -> None:
    """Creates the tables (name to key and schema) that don't exist, empty."""
    for name, (_, schema) in tables.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def write_facts(spark: SparkSession, root: str, tables: dict[str, tuple[str, str]], name: str, rows: DataFrame) -> None:
    """Upserts rows into one of the tables by its key; an unknown table is an error, no rows change nothing."""
    if name not in tables:
        raise ValueError(f"unknown table {name}")
    if not rows.isEmpty():
        upsert_path(spark, f"{root}/{name}", rows, tables[name][0])


def report(df: DataFrame, folder: str) -> None:
    """A report as CSV with a header and as JSON lines."""
    df.write.mode("overwrite").option("header", "true").csv(f"{folder}/csv")
    df.write.mode("overwrite").json(f"{folder}/json")


def log(df: DataFrame, path: str) -> None:
    """Appends one JSON object per row."""
    df.write.mode("append").json(path)


def write_texts(df: DataFrame, path: str, content: str, root: str) -> int:
    """Writes each row's text to its relative path below a shared folder (a path or any address that Arrow's file systems know), UTF-8 with \\n; returns how many were written.

    A text is written beside its place and then moved there, so a repeated task leaves whole files.
    """

    def run(frames):
        import posixpath
        import uuid

        import pandas as pd
        from pyarrow import fs

        to, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
        for pdf in frames:
            for p, t in zip(pdf["p"], pdf["t"]):
                at = posixpath.normpath(posixpath.join(base, p))
                if not at.startswith(posixpath.normpath(base) + "/"):
                    raise ValueError(f"{p} leads out of {root}")
                to.create_dir(posixpath.dirname(at), recursive=True)
                beside = f"{at}.{uuid.uuid4().hex}"
                with to.open_output_stream(beside) as f:
                    f.write((t or "").encode("utf-8", "replace"))
                to.move(beside, at)
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.selectExpr(f"`{path}` AS p", f"`{content}` AS t").mapInPandas(run, "n long").groupBy().sum("n").first()[0] or 0


def kusto_read(spark: SparkSession, options: dict[str, str], query: str) -> DataFrame:
    """Reads a query's result through the Kusto connector, where its jar is on the class path."""
    return spark.read.format("com.microsoft.kusto.spark.datasource").options(**options).option("kustoQuery", query).load()


def kusto_write(df: DataFrame, options: dict[str, str]) -> None:
    """Appends through the Kusto connector in its streaming mode."""
    df.write.format("com.microsoft.kusto.spark.datasource").options(**options).option("writeMode", "KustoStreaming").mode("append").save()
