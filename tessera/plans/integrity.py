"""Snapshot changes and orphan references over the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_id, reference_id, state
from tessera.operators.orphans import lifetimes, orphan_references
from tessera.operators.snapshot_diff import snapshot_changes
from tessera.session import table


def _mpe_changes(spark: SparkSession, sf_dir: str, with_values: bool) -> DataFrame:
    m = table(spark, sf_dir, "mpe_inventory").select("run_label", "mpe_id", "provisioning_state", "connection_status", "collected_at")
    return snapshot_changes(
        m,
        run=F.col("run_label"),
        key={"mpe_id": canonical_id(F.col("mpe_id"))},
        values={"provisioning_state": state(F.col("provisioning_state")), "connection_status": state(F.col("connection_status"))},
        read_at=F.col("collected_at"),
        with_values=with_values,
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints added, removed or changed between each inventory run and the one before."""
    return _mpe_changes(spark, sf_dir, False).select("run_label", "mpe_id", "change_kind")


def p2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p2_found`` with the states before and after."""
    return _mpe_changes(spark, sf_dir, True)


#: table, row key, reference, time of the reference, target
REFERENCES = (
    ("fact_scan_findings", "finding_id", "workspace_id", "detected_at", "dim_workspace"),
    ("fabric_url_scanner", "row_id", "dest_workspace_id", "scanned_at", "dim_workspace"),
    ("scan_results", "result_id", "attached_lakehouse_id", "scanned_at", "item_inventory"),
)


#: Targets: table, id
TARGETS = (("dim_workspace", "workspace_id"), ("item_inventory", "item_id"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of all tables, repeated deliveries left out.

    All targets share one set of runs, their keys being told apart by a number, so all references are matched together.
    """
    numbers = {t: n for n, (t, _) in enumerate(TARGETS)}
    parents = reduce(DataFrame.unionByName, [lifetimes(table(spark, sf_dir, t), canonical_id(F.col(k)), F.col("first_seen"), F.col("deleted_at"), numbers[t]) for t, k in TARGETS])
    refs = reduce(
        DataFrame.unionByName,
        [
            table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col(k).cast("string").alias("row_key"), F.lit(c).alias("ref_column"), reference_id(F.col(c)).alias("ref_id"), F.col(at).alias("ref_at"), F.lit(numbers[to]).alias("target"))
            for t, k, c, at, to in REFERENCES
        ],
    )
    return orphan_references(refs, parents, F.col("target")).drop("target")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose target did not exist when they were made."""
    return orphans(spark, sf_dir).select("table_name", "row_key", "ref_column", "orphan_kind").distinct()


def p4_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, column, month (NULL without a time) and kind."""
    month = F.date_format("ref_at", "yyyy-MM").alias("month")
    return orphans(spark, sf_dir).distinct().groupBy("table_name", "ref_column", month, "orphan_kind").agg(F.count("*").alias("orphans"), F.countDistinct("ref_id").alias("targets"))


QUERIES = {"p2_found": p2_found, "p2_changes": p2_changes, "p4_found": p4_found, "p4_by_month": p4_by_month}


def _sql_id(c: str) -> str:
    h = f"lower(regexp_replace({c}, '[^0-9A-Fa-f]', '', 'g'))"
    return f"CASE WHEN length({h}) = 32 THEN regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') WHEN trim({c}) <> '' THEN lower(trim({c})) END"


_SNAP = f"""
WITH read AS (
  SELECT run_label, {_sql_id("mpe_id")} AS mpe_id, lower(trim(coalesce(provisioning_state, ''))) AS ps,
         lower(trim(coalesce(connection_status, ''))) AS cs, collected_at
  FROM mpe_inventory),
held AS (SELECT run_label, mpe_id, arg_max(ps, collected_at) AS ps, arg_max(cs, collected_at) AS cs
         FROM read WHERE mpe_id IS NOT NULL AND run_label IS NOT NULL GROUP BY 1, 2),
runs AS (SELECT run_label, lag(run_label) OVER (ORDER BY run_label) AS before FROM (SELECT DISTINCT run_label FROM held)),
pairs AS (
  SELECT coalesce(n.run_label, o.after) AS run_label, coalesce(n.mpe_id, o.mpe_id) AS mpe_id, n.ps AS nps, n.cs AS ncs, o.ps AS ops, o.cs AS ocs,
         n.mpe_id IS NOT NULL AS is_new, o.mpe_id IS NOT NULL AS is_old
  FROM (SELECT h.*, r.before FROM held h JOIN runs r USING (run_label) WHERE r.before IS NOT NULL) n
  FULL JOIN (SELECT h.*, r.run_label AS after FROM held h JOIN runs r ON h.run_label = r.before) o ON n.before = o.run_label AND n.mpe_id = o.mpe_id),
diff AS (SELECT *, CASE WHEN NOT is_old THEN 'added' WHEN NOT is_new THEN 'removed' ELSE 'changed' END AS change_kind
         FROM pairs WHERE NOT is_old OR NOT is_new OR nps <> ops OR ncs <> ocs)
"""

_ORPHANS = "WITH refs AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({k} AS VARCHAR) AS row_key, '{c}' AS ref_column, {_sql_id(c)} AS ref_id, {at} AS ref_at, '{to}' AS target FROM {t}" for t, k, c, at, to in REFERENCES
) + f"""), known AS (SELECT DISTINCT * FROM refs WHERE ref_id IS NOT NULL AND regexp_replace(ref_id, '[0-]', '', 'g') <> ''),
parents AS (SELECT 'dim_workspace' AS target, {_sql_id("workspace_id")} AS id, first_seen, deleted_at FROM dim_workspace
            UNION ALL SELECT 'item_inventory', {_sql_id("item_id")}, first_seen, deleted_at FROM item_inventory),
judged AS (
  SELECT k.table_name, k.row_key, k.ref_column, k.ref_id, k.ref_at, count(p.id) AS n,
         coalesce(bool_or(p.first_seen <= k.ref_at AND (p.deleted_at IS NULL OR p.deleted_at > k.ref_at)), false) AS alive,
         coalesce(bool_and(p.first_seen > k.ref_at), false) AS late
  FROM known k LEFT JOIN parents p ON p.target = k.target AND p.id = k.ref_id GROUP BY ALL),
orphans AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN ref_at IS NULL THEN NULL WHEN alive THEN NULL WHEN late THEN 'late' ELSE 'deleted' END AS orphan_kind FROM judged)
"""

ORACLE = {
    "p2_found": _SNAP + "SELECT run_label, mpe_id, change_kind FROM diff",
    "p2_changes": _SNAP + "SELECT run_label, mpe_id, change_kind, ops AS old_provisioning_state, ocs AS old_connection_status, nps AS new_provisioning_state, ncs AS new_connection_status FROM diff",
    "p4_found": _ORPHANS + "SELECT DISTINCT table_name, row_key, ref_column, orphan_kind FROM orphans WHERE orphan_kind IS NOT NULL",
    "p4_by_month": _ORPHANS + "SELECT table_name, ref_column, strftime(ref_at, '%Y-%m') AS month, orphan_kind, count(*) AS orphans, count(DISTINCT ref_id) AS targets FROM orphans WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
