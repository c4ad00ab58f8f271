"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import audit, catalogue, endpoints, findings, first_generation, integrity, manifest, pipelines, planted, scans

MODULES = (integrity, findings, first_generation, endpoints, manifest, audit, scans, catalogue, pipelines, planted)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["review_queue"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
