"""Rollups of the first generation's findings table: one row per address, secret, write call or failed document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.findings import _n
from tessera.session import table

_DISTINCT = "notebook_id"


# The direction of each counter.
DIRECTIONS = {"url_reads": "read", "url_writes": "write", "url_read_writes": "read_write", "url_references": "reference", "url_unknown": "unknown"}
_PAIRS = (
    ("total_urls", "notebooks_with_urls", "url IS NOT NULL"),
    ("total_secrets", "notebooks_with_secrets", "secret_type IS NOT NULL"),
    ("potential_write_calls", "notebooks_with_potential_writes", "direction = 'potential_write'"),
    ("cross_workspace_urls", "notebooks_with_cross_ws", "cross_workspace = true"),
)


def overview(f: DataFrame) -> DataFrame:
    """One row of counters over the whole table.

    Counted per notebook first, so no row is multiplied for the distinct counts; rows without a notebook count as rows only.
    """
    rows = {r: F.expr(c) for r, _, c in _PAIRS} | {"error_rows": F.col("error").isNotNull()} | {n: F.col("direction") == d for n, d in DIRECTIONS.items()}
    per = f.groupBy(_DISTINCT).agg(*[_n(c).alias(n) for n, c in rows.items()])
    with_id = F.col(_DISTINCT).isNotNull()
    notebooks = [F.count(_DISTINCT).alias("notebooks_scanned")] + [_n(with_id & (F.col(r) > 0)).alias(n) for r, n, _ in _PAIRS]
    # no rows give zeros
    return per.agg(*notebooks, *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in rows])


def _counted(f: DataFrame, *keys) -> DataFrame:
    return f.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.countDistinct(_DISTINCT).alias("notebooks"))


def direction_by_kind(f: DataFrame) -> DataFrame:
    return _counted(f.where("url IS NOT NULL"), "direction", "source_kind")


def host(url: Column) -> Column:
    """The host of an address with a lower-case scheme, '' for any other."""
    return F.regexp_extract(url, "^[a-z]+://([^/]+)", 1)


def host_rollup(f: DataFrame) -> DataFrame:
    return _counted(f.where("url IS NOT NULL"), host(F.col("url")).alias("host"), "direction").orderBy(F.desc("occurrences"), "host", F.asc_nulls_first("direction")).limit(25)


def write_urls(f: DataFrame) -> DataFrame:
    shown = f.where(F.col("direction").isin("write", "read_write")).select("row_id", "workspace_id", "workspace_name", "notebook_id", "display_name", "part_path", "url", "dest_workspace_id", "dest_workspace_name", "cross_workspace").distinct()
    return shown.orderBy(F.asc_nulls_first("workspace_name"), F.asc_nulls_first("notebook_id"), "row_id").limit(200)


def cross_workspace(f: DataFrame) -> DataFrame:
    keys = [F.col("workspace_name").alias("source_workspace"), "dest_workspace_name", "dest_workspace_id", "direction"]
    order = [F.asc_nulls_first(c) for c in ("source_workspace", "dest_workspace_name", "dest_workspace_id", "direction")]
    return _counted(f.where("cross_workspace = true"), *keys).orderBy(F.desc("occurrences"), *order).limit(100)


def cross_workspace_rows(f: DataFrame) -> DataFrame:
    shown = f.where("cross_workspace = true").select("row_id", "workspace_id", F.col("workspace_name").alias("source_workspace"), "notebook_id", "display_name", "dest_workspace_id", "dest_workspace_name", "direction", "part_path", "url").distinct()
    return shown.orderBy(F.asc_nulls_first("source_workspace"), F.asc_nulls_first("dest_workspace_name"), F.asc_nulls_first("notebook_id"), "row_id").limit(200)


def secret_types(f: DataFrame) -> DataFrame:
    return _counted(f.where("secret_type IS NOT NULL"), "secret_type")


def secret_rows(f: DataFrame) -> DataFrame:
    shown = f.where("secret_type IS NOT NULL").select("row_id", "workspace_id", "workspace_name", "notebook_id", "display_name", "part_path", "secret_type", "source_kind", "match_snippet").distinct()
    return shown.orderBy(F.asc_nulls_first("workspace_name"), F.asc_nulls_first("notebook_id"), "secret_type", "row_id").limit(200)


def write_signatures(f: DataFrame) -> DataFrame:
    return _counted(f.where("direction = 'potential_write'"), F.col("secret_type").alias("write_signature"))


def notebook_review_queue(f: DataFrame) -> DataFrame:
    """Documents that write, with the kind of review they need.  Names are the smallest of the group, so they don't depend on the order of rows."""
    per = f.groupBy("workspace_id", "notebook_id").agg(
        F.min("workspace_name").alias("workspace_name"),
        F.min("display_name").alias("display_name"),
        _n(F.col("direction") == "potential_write").alias("potential_writes"),
        _n(F.col("direction") == "write").alias("literal_write_urls"),
        _n(F.col("direction") == "read_write").alias("literal_read_write_urls"),
        _n(F.col("cross_workspace")).alias("cross_workspace_urls"),
        # a write call keeps its signature in secret_type, so it is told apart NULL-safely
        _n(F.col("secret_type").isNotNull() & ~F.col("direction").eqNullSafe("potential_write")).alias("secret_count"),
    )
    literal = F.col("literal_write_urls") + F.col("literal_read_write_urls")
    status = F.when((F.col("potential_writes") > 0) & (literal == 0), "flag_for_review").when(F.col("cross_workspace_urls") > 0, "cross_workspace_write").otherwise("has_literal_write_url")
    return per.where((F.col("potential_writes") > 0) | (literal > 0)).withColumn("review_status", status)


def review_status_counts(f: DataFrame) -> DataFrame:
    return notebook_review_queue(f).groupBy("review_status").agg(F.count("*").alias("notebooks"))


def flagged_notebooks(f: DataFrame) -> DataFrame:
    shown = notebook_review_queue(f).where("review_status = 'flag_for_review'").select("workspace_id", "workspace_name", "notebook_id", "display_name", "potential_writes", "cross_workspace_urls", "secret_count")
    return shown.orderBy(F.desc("potential_writes"), F.desc("secret_count"), F.asc_nulls_first("workspace_id"), F.asc_nulls_first("notebook_id")).limit(200)


def summary(f: DataFrame) -> DataFrame:
    """The five totals of a run; a write call's signature is no secret."""
    counted = lambda c: F.sum(F.when(F.expr(c), 1))  # noqa: E731  none at all gives NULL
    per = f.groupBy(_DISTINCT).agg(counted("url IS NOT NULL").alias("urls"), counted("secret_type IS NOT NULL AND direction <> 'potential_write'").alias("secrets"), counted("direction = 'potential_write'").alias("potential_writes"), counted("cross_workspace = true").alias("cross_ws"))
    return per.agg(F.count(_DISTINCT).alias("notebooks"), *[F.sum(c).alias(c) for c in ("urls", "secrets", "potential_writes", "cross_ws")])


def flows(f: DataFrame) -> DataFrame:
    """Flows between workspaces by name, most rows first."""
    counted = f.where("cross_workspace = true").groupBy(F.col("workspace_name").alias("source"), F.col("dest_workspace_name").alias("dest"), "direction").agg(F.count("*").alias("rows"))
    return counted.orderBy(F.desc("rows"))


def needs_review(f: DataFrame) -> DataFrame:
    return notebook_review_queue(f).where(F.col("review_status").isin("flag_for_review", "cross_workspace_write"))


ROLLUPS = {f.__name__: f for f in (overview, summary, flows, needs_review, direction_by_kind, host_rollup, write_urls, cross_workspace, cross_workspace_rows, secret_types, secret_rows, write_signatures, notebook_review_queue, review_status_counts, flagged_notebooks)}


def _over(rollup):
    return lambda spark, sf_dir: rollup(table(spark, sf_dir, "fabric_url_scanner"))


QUERIES = {f"v1_{n}": _over(f) for n, f in ROLLUPS.items()}

_T = "fabric_url_scanner"
_COUNTS = "count(*) AS occurrences, count(DISTINCT notebook_id) AS notebooks"
_QUEUE = f"""WITH per AS (SELECT workspace_id, notebook_id, min(workspace_name) AS workspace_name, min(display_name) AS display_name,
  count(*) FILTER (direction = 'potential_write') AS potential_writes, count(*) FILTER (direction = 'write') AS literal_write_urls, count(*) FILTER (direction = 'read_write') AS literal_read_write_urls,
  count(*) FILTER (cross_workspace) AS cross_workspace_urls, count(*) FILTER (secret_type IS NOT NULL AND direction IS DISTINCT FROM 'potential_write') AS secret_count FROM {_T} GROUP BY 1, 2),
queue AS (SELECT *, CASE WHEN potential_writes > 0 AND literal_write_urls = 0 AND literal_read_write_urls = 0 THEN 'flag_for_review' WHEN cross_workspace_urls > 0 THEN 'cross_workspace_write' ELSE 'has_literal_write_url' END AS review_status
  FROM per WHERE potential_writes > 0 OR literal_write_urls > 0 OR literal_read_write_urls > 0)
"""
ORACLE = {
    "v1_overview": "SELECT count(DISTINCT notebook_id) AS notebooks_scanned, "
    + ", ".join(f"count(*) FILTER ({c}) AS {r}, count(DISTINCT notebook_id) FILTER ({c}) AS {n}" for r, n, c in _PAIRS)
    + ", count(*) FILTER (error IS NOT NULL) AS error_rows, "
    + ", ".join(f"count(*) FILTER (direction = '{d}') AS {n}" for n, d in DIRECTIONS.items())
    + f" FROM {_T}",
    "v1_direction_by_kind": f"SELECT direction, source_kind, {_COUNTS} FROM {_T} WHERE url IS NOT NULL GROUP BY 1, 2",
    "v1_host_rollup": f"SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, direction, {_COUNTS} FROM {_T} WHERE url IS NOT NULL GROUP BY 1, 2 ORDER BY occurrences DESC, host, direction NULLS FIRST LIMIT 25",
    "v1_write_urls": f"SELECT DISTINCT row_id, workspace_id, workspace_name, notebook_id, display_name, part_path, url, dest_workspace_id, dest_workspace_name, cross_workspace FROM {_T} WHERE direction IN ('write', 'read_write') ORDER BY workspace_name NULLS FIRST, notebook_id NULLS FIRST, row_id LIMIT 200",
    "v1_cross_workspace": f"SELECT workspace_name AS source_workspace, dest_workspace_name, dest_workspace_id, direction, {_COUNTS} FROM {_T} WHERE cross_workspace GROUP BY 1, 2, 3, 4 ORDER BY occurrences DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST LIMIT 100",
    "v1_cross_workspace_rows": f"SELECT DISTINCT row_id, workspace_id, workspace_name AS source_workspace, notebook_id, display_name, dest_workspace_id, dest_workspace_name, direction, part_path, url FROM {_T} WHERE cross_workspace ORDER BY source_workspace NULLS FIRST, dest_workspace_name NULLS FIRST, notebook_id NULLS FIRST, row_id LIMIT 200",
    "v1_secret_types": f"SELECT secret_type, {_COUNTS} FROM {_T} WHERE secret_type IS NOT NULL GROUP BY 1",
    "v1_secret_rows": f"SELECT DISTINCT row_id, workspace_id, workspace_name, notebook_id, display_name, part_path, secret_type, source_kind, match_snippet FROM {_T} WHERE secret_type IS NOT NULL ORDER BY workspace_name NULLS FIRST, notebook_id NULLS FIRST, secret_type, row_id LIMIT 200",
    "v1_write_signatures": f"SELECT secret_type AS write_signature, {_COUNTS} FROM {_T} WHERE direction = 'potential_write' GROUP BY 1",
    "v1_notebook_review_queue": _QUEUE + "SELECT * FROM queue",
    "v1_summary": f"SELECT count(DISTINCT notebook_id) AS notebooks, sum(CASE WHEN url IS NOT NULL THEN 1 END) AS urls, sum(CASE WHEN secret_type IS NOT NULL AND direction <> 'potential_write' THEN 1 END) AS secrets, sum(CASE WHEN direction = 'potential_write' THEN 1 END) AS potential_writes, sum(CASE WHEN cross_workspace THEN 1 END) AS cross_ws FROM {_T}",
    "v1_flows": f"SELECT workspace_name AS source, dest_workspace_name AS dest, direction, count(*) AS rows FROM {_T} WHERE cross_workspace GROUP BY 1, 2, 3",
    "v1_needs_review": _QUEUE + "SELECT * FROM queue WHERE review_status IN ('flag_for_review', 'cross_workspace_write')",
    "v1_review_status_counts": _QUEUE + "SELECT review_status, count(*) AS notebooks FROM queue GROUP BY 1",
    "v1_flagged_notebooks": _QUEUE + "SELECT workspace_id, workspace_name, notebook_id, display_name, potential_writes, cross_workspace_urls, secret_count FROM queue WHERE review_status = 'flag_for_review' ORDER BY potential_writes DESC, secret_count DESC, workspace_id NULLS FIRST, notebook_id NULLS FIRST LIMIT 200",
}
