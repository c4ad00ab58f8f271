"""The latest row per key, three ways, and keyed upsert without a transactional table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_with_ties(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """All rows of the greatest ``at`` per key; rows with a NULL key or time drop out, as a tuple of them equals nothing."""
    newest = df.groupBy(*keys).agg(F.max(at).alias("__newest"))
    on = [df[k] == newest[k] for k in keys] + [df[at] == newest["__newest"]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(newest, condition, "left_semi")


def latest_row(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """One row per key, combined before the shuffle; among equal times the greatest remaining values."""
    rest = [c for c in df.columns if c not in keys and c != at]
    picked = df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("__row"))
    return picked.select(*[F.col(k) if k in keys else F.col("__row")[k].alias(k) for k in df.columns])


def first_by_window(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row per key in an order; the order should end in a unique column."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Target rows whose key isn't in the source, and the source's rows.

    Repeated keys of the source are reduced to one row first (the greatest ``order``, else the greatest values), so a key never
    matches twice.  NULL keys of the target stay; those of the source are left out.  Columns of the target lead;
    missing ones of the source become NULL.
    """
    named = source.where(F.col(key).isNotNull())
    one = latest_row(named, [key], order or next((c for c in named.columns if c != key), key)) if len(named.columns) > 1 else named.distinct()
    stay = target.join(one.select(key), key, "left_anti").select(*target.columns)
    return stay.unionByName(one.select(*[c for c in target.columns if c in one.columns]), allowMissingColumns=True)


POINTER = "_current"


def _files(spark: SparkSession, path: str):
    """Hadoop's path class and the folder's file context."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).getFileSystem(conf).getUri(), conf), at(path).getFileSystem(conf)


def _version(spark: SparkSession, path: str) -> str | None:
    """Name of the folder that holds the table's current content, None before the first upsert."""
    at, _, fs = _files(spark, path)
    pointer = at(f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> DataFrame:
    """A table that upserts write: the version its pointer names, or the folder itself before the first upsert."""
    name = _version(spark, path)
    return spark.read.parquet(f"{path}/{name}" if name else path)


def upsert_path(spark: SparkSession, path: str, source: DataFrame, key: str, order: str | None = None) -> None:
    """Upserts into a parquet folder: writes the merged table as a new version, then moves a pointer to it in one step.

    A reader (``current``) sees the old version or the new one, never neither; the version before stays for those that still read it, older ones go.
    """
    before = _version(spark, path)
    new = f"_v-{uuid.uuid4().hex}"
    upsert(current(spark, path), source, key, order).write.parquet(f"{path}/{new}")
    at, context, fs = _files(spark, path)
    aside = f"{path}/{POINTER}-{uuid.uuid4().hex}"
    out = fs.create(at(aside), True)
    out.write(bytearray(new.encode()))
    out.close()
    option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(option, 1)
    how[0] = option.OVERWRITE
    context.rename(at(aside), at(f"{path}/{POINTER}"), how)
    for found in fs.listStatus(at(path)):
        name = found.getPath().getName()
        if name.startswith("_v-") and name not in (new, before):
            fs.delete(found.getPath(), True)
