"""Session settings and table access shared by all plans."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitted configuration is used as it is."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master or not os.environ.get("SPARK_MASTER"):
        b = (
            b.master(master or f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        )
    return b.getOrCreate()


def guard_unions(spark: SparkSession) -> None:
    """Keeps a union from claiming its inputs' partitioning.

    Spark 4.1 lets an aggregate or join after a union of equally partitioned inputs go without an
    exchange; adaptive execution then coalesces each input by itself, and equal keys
    end in different tasks (seen as repeated groups).  Without the claim the exchange comes back.
    """
    if spark.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, where they couldn't import it otherwise.

    Workers find it by themselves when the driver runs in the package's folder or names it in PYTHONPATH.
    """
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or any(p and Path(p).resolve() == root for p in known):
        return
    _shipped.add(app)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera"), "zip", root, "tessera"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a parquet file or a folder of them)."""
    guard_unions(spark)
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, from spark.checkpoint.dir.

    A temporary folder is set only on a local master (tests), where driver and tasks share one machine; on a
    cluster a session that names none is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    spark.sparkContext.setCheckpointDir(at)
    return at
