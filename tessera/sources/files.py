"""Documents in files: binary scans, dated folders, and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import attribute
from tessera.functions.text import base_name


def binary_documents(spark: SparkSession, roots: list[str], glob: str = "*.{ipynb,py,json,md}", most: int | None = None) -> DataFrame:
    """path, modificationTime, length and content of all documents below the roots.

    ``most`` takes the first documents by path, so a cap is the same on every run.  Raises where nothing matches.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no documents like {glob} below {', '.join(roots)}")
    # the paths alone are sorted; contents are read of the chosen ones only
    return files.join(F.broadcast(files.select("path").orderBy("path").limit(most)), "path", "left_semi") if most else files


def attributed(files: DataFrame, base: str | None = None, default_id: str | None = None, default_name: str | None = None) -> DataFrame:
    """The files with workspace_id, workspace_name and source_dated_partition read off their paths."""
    id_, name, date = attribute(F.col("path"), base, default_id, default_name)
    return files.withColumns({"workspace_id": id_, "workspace_name": name, "source_dated_partition": date})


def with_names(df: DataFrame, named: DataFrame, id_: str, name: str) -> DataFrame:
    """The frame with the name that ``named`` (id, name) has for its id, whatever its case; a name that is there stays, an id of several names gets the smallest."""
    known = named.where("id <> '' AND name <> ''").groupBy(F.lower("id").alias("__id")).agg(F.min("name").alias("__name"))
    joined = df.join(known, F.lower(id_) == F.col("__id"), "left")
    own = F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")
    return joined.withColumn(name, F.coalesce(own, "__name")).drop("__id", "__name")


def snapshot(files: DataFrame) -> DataFrame:
    """An inventory of the files; their contents are never read."""
    return files.select("path", base_name(F.col("path")).alias("display_name"), "length", "modificationTime", *[c for c in ("workspace_id", "workspace_name", "source_dated_partition") if c in files.columns])


def latest_partitions(files: DataFrame) -> DataFrame:
    """The files of each workspace's latest dated folder; undated files stay."""
    newest = files.where("source_dated_partition IS NOT NULL").groupBy("workspace_id").agg(F.max("source_dated_partition").alias("__newest"))
    joined = files.join(newest, "workspace_id", "left")
    return joined.where("source_dated_partition IS NULL OR source_dated_partition = __newest").drop("__newest").select(*files.columns)


def spread(files: DataFrame, n: int, per_task: int = 200) -> DataFrame:
    """The files over ceil(n / per_task) tasks."""
    return files.repartition(max(1, -(-n // per_task)))


ITEM = "id string, name string, displayName string, type string, workspaceId string, workspaceName string"


def items(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Item descriptors as they are enumerated; the name falls back to the id, the type to Notebook."""
    plain = [tuple(r.get(c.split()[0]) for c in ITEM.split(", ")) for r in rows]
    df = spark.createDataFrame(plain, ITEM)
    return df.withColumn("displayName", F.coalesce(F.nullif("displayName", F.lit("")), F.nullif("name", F.lit("")), "id")).withColumn("type", F.coalesce(F.nullif("type", F.lit("")), F.lit("Notebook")))


def replayed(spark: SparkSession, table: str, column: str) -> DataFrame | None:
    """Distinct values of a column of a table of an earlier run, or None where there is no such table."""
    return spark.table(table).select(column).distinct() if spark.catalog.tableExists(table) else None


def reread(spark: SparkSession, path: str, view: str) -> DataFrame:
    """A folder that a run has written, under a name that SQL can use."""
    spark.read.parquet(path).createOrReplaceTempView(view)
    return spark.table(view)
