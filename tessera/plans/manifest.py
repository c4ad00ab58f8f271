"""Rollups of the download manifest (21 columns).

The test tables hold no manifest; ``manifest_of_events`` reads one off the
events: the kind of event as status and item type, its value as size, its user as workspace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.findings import _n
from tessera.session import table


def manifest_of_events(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skipped_exists").otherwise("ok")
    return e.select(
        F.concat(F.lit("ws-"), F.pmod("user_id", F.lit(40))).alias("workspace_id"),
        F.concat(F.lit("Workspace "), F.pmod("user_id", F.lit(40))).alias("workspace_name"),
        F.concat(F.lit("type-"), F.pmod(k, F.lit(4))).alias("item_type"),
        F.col("event_id").cast("string").alias("item_id"),
        F.concat(F.lit("item "), F.col("event_id")).alias("display_name"),
        F.when(k < 5, "ipynb").otherwise("parts").alias("export_format"),
        k.alias("part_count"),
        F.pmod(k, F.lit(3)).alias("parts_saved"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("has_content_part"),
        F.round(F.col("value") * 1000).cast("long").alias("payload_bytes"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"),
        k.alias("attempts"),
        (k % 2).alias("token_refreshes"),
        (F.lit(200) + k * 40).alias("http_status"),
        status.alias("status"),
        F.when(status == "error", F.concat(F.lit("failed "), k)).alias("error"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_label"),
        F.col("ts").alias("downloaded_at"),
    )


def _mb() -> Column:
    return F.sum(F.coalesce("payload_bytes", F.lit(0))).cast("double") / F.lit(1048576.0).cast("double")


_STATES = (("downloaded", "ok"), ("skipped", "skipped_exists"), ("errors", "error"))


def _sums() -> list:
    return [*[_n(F.col("status") == s).alias(n) for n, s in _STATES], _mb().alias("total_mb")]


def by_status(m: DataFrame) -> DataFrame:
    return m.groupBy("status").agg(F.count("*").alias("n"), _mb().alias("total_mb"))


def by_type(m: DataFrame) -> DataFrame:
    return m.groupBy("item_type").agg(*_sums())


def by_workspace(m: DataFrame) -> DataFrame:
    return m.groupBy("workspace_name", "workspace_id").agg(*_sums()).orderBy(F.desc("downloaded"), "workspace_name", "workspace_id").limit(500)


_ITEM = ("workspace_name", "item_type", "display_name", "item_id")


def errors(m: DataFrame) -> DataFrame:
    return m.where("status = 'error'").select(*_ITEM, "http_status", "attempts", "token_refreshes", "sha256", "error").orderBy(*_ITEM).limit(500)


def balance_check(m: DataFrame) -> DataFrame:
    """Items without their main part, or of which nothing was saved; an unknown main part counts as missing."""
    bad = (F.col("has_content_part") == F.lit(False)) | F.col("has_content_part").isNull() | ((F.col("parts_saved") == 0) & (F.col("status") != "skipped_exists"))
    return m.where(bad).select(*_ITEM, "export_format", "part_count", "parts_saved", "has_content_part", "status", "error").orderBy(*_ITEM).limit(500)


def run_summary(m: DataFrame) -> DataFrame:
    return m.groupBy("run_label").agg(
        F.count("*").alias("items_attempted"),
        *[_n(F.col("status") == s).alias({"downloaded": "ok"}.get(n, n)) for n, s in _STATES],
        F.sum("token_refreshes").alias("total_token_refreshes"),
        F.round(_mb(), 2).alias("total_mb"),
        F.min("downloaded_at").alias("started_at"),
        F.max("downloaded_at").alias("ended_at"),
    )


ROLLUPS = {f.__name__: f for f in (by_status, by_type, by_workspace, errors, balance_check, run_summary)}


def _over(rollup):
    return lambda spark, sf_dir: rollup(manifest_of_events(table(spark, sf_dir, "events")))


QUERIES = {f"manifest_{n}": _over(f) for n, f in ROLLUPS.items()}

_M = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
m AS (SELECT 'ws-' || user_id % 40 AS workspace_id, 'Workspace ' || user_id % 40 AS workspace_name, 'type-' || k % 4 AS item_type, CAST(event_id AS VARCHAR) AS item_id, 'item ' || event_id AS display_name,
  CASE WHEN k < 5 THEN 'ipynb' ELSE 'parts' END AS export_format, k AS part_count, k % 3 AS parts_saved, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_content_part, CAST(round(value * 1000) AS BIGINT) AS payload_bytes,
  sha256(CAST(event_id AS VARCHAR)) AS sha256, k AS attempts, k % 2 AS token_refreshes, 200 + k * 40 AS http_status, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped_exists' ELSE 'ok' END AS status,
  CASE event_type WHEN 'error' THEN 'failed ' || k END AS error, strftime(ts, '%Y-%m-%d') AS run_label, ts AS downloaded_at FROM e)
"""
_SQL_MB = "CAST(sum(coalesce(payload_bytes, 0)) AS DOUBLE) / 1048576.0"
_SQL_SUMS = ", ".join(f"count(*) FILTER (status = '{s}') AS {n}" for n, s in _STATES) + f", {_SQL_MB} AS total_mb"
ORACLE = {
    "manifest_by_status": _M + f"SELECT status, count(*) AS n, {_SQL_MB} AS total_mb FROM m GROUP BY 1",
    "manifest_by_type": _M + f"SELECT item_type, {_SQL_SUMS} FROM m GROUP BY 1",
    "manifest_by_workspace": _M + f"SELECT workspace_name, workspace_id, {_SQL_SUMS} FROM m GROUP BY 1, 2 ORDER BY downloaded DESC, 1, 2 LIMIT 500",
    "manifest_errors": _M + "SELECT workspace_name, item_type, display_name, item_id, http_status, attempts, token_refreshes, sha256, error FROM m WHERE status = 'error' ORDER BY 1, 2, 3, 4 LIMIT 500",
    "manifest_balance_check": _M + "SELECT workspace_name, item_type, display_name, item_id, export_format, part_count, parts_saved, has_content_part, status, error FROM m WHERE has_content_part = false OR has_content_part IS NULL OR (parts_saved = 0 AND status <> 'skipped_exists') ORDER BY 1, 2, 3, 4 LIMIT 500",
    "manifest_run_summary": _M + f"SELECT run_label, count(*) AS items_attempted, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped_exists') AS skipped, count(*) FILTER (status = 'error') AS errors, CAST(sum(token_refreshes) AS BIGINT) AS total_token_refreshes, round({_SQL_MB}, 2) AS total_mb, min(downloaded_at) AS started_at, max(downloaded_at) AS ended_at FROM m GROUP BY 1",
}
