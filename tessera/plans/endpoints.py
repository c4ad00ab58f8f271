"""Private endpoints: inventory rollups, filters, latest rows and the lifecycle of deletion, recreation and approval.

The audit tables of the lifecycle have no test table of their own; customers
stand for deleted endpoints, their orders for recreated ones and the orders' lines for
approvals, joined on the same keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import api_version, logical_key, resource_provider, run_label
from tessera.operators.latest import first_by_window, latest_row, latest_with_ties
from tessera.session import table

T = "mpe_inventory"


def by_subresource(m: DataFrame) -> DataFrame:
    return m.groupBy("target_subresource_type").agg(F.count("*").alias("endpoints"))


def by_states(m: DataFrame) -> DataFrame:
    return m.groupBy("provisioning_state", "connection_status").agg(F.count("*").alias("endpoints"))


def matching(m: DataFrame, name: str | None = None, ids: list[str] | None = None, target: str | None = None, workspaces: DataFrame | None = None) -> DataFrame:
    """Endpoints whose id is one of ``ids``, whose workspace is one of ``workspaces`` (workspace_id) and whose name and target match the patterns; NULL counts as ''; no filter lets all pass."""
    if workspaces is not None:
        m = m.join(workspaces.select("workspace_id").distinct(), "workspace_id", "left_semi")
    if ids:
        m = m.where(F.col("mpe_id").isin(*ids))
    if name:
        m = m.where(F.coalesce("mpe_name", F.lit("")).rlike(name))
    if target:
        m = m.where(F.coalesce("target_resource_id", F.lit("")).rlike(target))
    return m


def capped(m: DataFrame, most: int) -> DataFrame:
    """The frame itself, or an error when more rows than ``most`` match: the guard before anything is changed."""
    if m.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows match")
    return m


def recent(m: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return m.where(F.col("collected_at") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def lifecycle(deleted: DataFrame, recreated: DataFrame, approved: DataFrame) -> DataFrame:
    """Every successful deletion with its recreations and their approvals; several of them give several rows."""
    d = deleted.where("delete_status BETWEEN 200 AND 299")
    return d.join(recreated, d["mpe_id"] == recreated["original_mpe_id"], "left").join(approved, recreated["new_mpe_id"] == approved["approved_mpe_id"], "left").drop("original_mpe_id", "approved_mpe_id")


def _lifecycle_tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    return (
        c.select(F.col("c_custkey").alias("mpe_id"), F.col("c_name").alias("mpe_name"), (F.lit(200) + F.pmod(F.col("c_custkey"), F.lit(4)) * 67).alias("delete_status")),
        o.select(F.col("o_custkey").alias("original_mpe_id"), F.col("o_orderkey").alias("new_mpe_id"), F.col("o_orderdate").alias("created_at"), (F.lit(200) + F.pmod(F.col("o_orderkey"), F.lit(5)) * 60).alias("create_status")),
        li.select(F.col("l_orderkey").alias("approved_mpe_id"), F.col("l_linenumber").alias("attempt"), F.col("l_shipdate").alias("approved_at"), F.col("l_linestatus").alias("new_connection_state")),
    )


def lifecycle_chain(spark, sf_dir: str) -> DataFrame:
    return lifecycle(*_lifecycle_tables(spark, sf_dir))


def recreate_failures(spark, sf_dir: str) -> DataFrame:
    r = _lifecycle_tables(spark, sf_dir)[1]
    return r.where("create_status >= 400").orderBy(F.desc("created_at"), "new_mpe_id")


def deletions_audited(spark, sf_dir: str) -> DataFrame:
    """The deletions of a run by status and name."""
    d = _lifecycle_tables(spark, sf_dir)[0]
    return d.orderBy("delete_status", F.asc_nulls_first("mpe_name"), "mpe_id")


def recreations_audited(spark, sf_dir: str) -> DataFrame:
    """The recreations of a run, with the names of what was deleted, by status and name."""
    d, r, _ = _lifecycle_tables(spark, sf_dir)
    named = r.join(d.select(F.col("mpe_id").alias("original_mpe_id"), "mpe_name"), "original_mpe_id", "left")
    return named.select("mpe_name", "original_mpe_id", "new_mpe_id", "create_status", "created_at").orderBy("create_status", F.asc_nulls_first("mpe_name"), "new_mpe_id")


def approvals_audited(spark, sf_dir: str) -> DataFrame:
    """The approvals of a run with the endpoint that each belongs to, by state."""
    _, r, a = _lifecycle_tables(spark, sf_dir)
    known = a.join(r.select(F.col("new_mpe_id").alias("approved_mpe_id"), "original_mpe_id"), "approved_mpe_id", "left")
    return known.select("approved_mpe_id", "original_mpe_id", "attempt", "new_connection_state", "approved_at").orderBy("new_connection_state", "approved_mpe_id", "attempt")


def failures_by_provider(spark, sf_dir: str) -> DataFrame:
    """Failed requests and the first status per kind; events stand for the approval audit, k telling the status."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("target_rp"), (F.lit(200) + F.get_json_object("props", "$.k").cast("int") * 40).alias("approve_status"))
    return e.where("approve_status >= 400").groupBy("target_rp").agg(F.count("*").alias("failed"), F.min("approve_status").alias("first_status"))


def pending(connections: DataFrame, body: str, marker: str | None) -> DataFrame:
    """Connections (JSON) that wait for approval and whose description holds the marker; without a marker any description."""
    state = "$.properties.privateLinkServiceConnectionState"
    waiting = F.lower(F.get_json_object(body, f"{state}.status")) == "pending"
    return connections.where(waiting & F.coalesce(F.get_json_object(body, f"{state}.description"), F.lit("")).contains(marker) if marker else waiting)


def with_first(connections: DataFrame, candidates: DataFrame, target: str, order: list[str]) -> DataFrame:
    """Each connection with the first candidate of its target."""
    return connections.join(first_by_window(candidates, [target], order), target, "left")


KEYS = ("workspace_id", "mpe_id")
_FEW = ("workspace_id", "mpe_id", "collected_at", "provisioning_state", "connection_status", "run_label")


def _mpe(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, T)


QUERIES = {
    "mpe_by_subresource": lambda s, d: by_subresource(_mpe(s, d)),
    "mpe_by_states": lambda s, d: by_states(_mpe(s, d)),
    "mpe_filtered": lambda s, d: matching(_mpe(s, d), name="(?i)^pe-(blob|vault)-", target="/providers/(blob|vault)/").select(*_FEW, "mpe_name", "target_resource_id"),
    "mpe_latest_in": lambda s, d: latest_with_ties(_mpe(s, d).select(*_FEW), KEYS, "collected_at"),
    "mpe_latest_max_by": lambda s, d: latest_row(_mpe(s, d).select(*_FEW), KEYS, "collected_at"),
    "mpe_latest_row_number": lambda s, d: first_by_window(_mpe(s, d).select(*_FEW), KEYS, [F.desc("collected_at"), F.desc_nulls_last("provisioning_state"), F.desc_nulls_last("connection_status"), F.desc_nulls_last("run_label")]),
    "mpe_recent": lambda s, d: recent(_mpe(s, d), "2025-12-10 00:00:00").select(*_FEW),
    "mpe_run_workspaces": lambda s, d: _mpe(s, d).where("run_label = 'inv-20250106'").select("workspace_id").distinct(),
    "mpe_providers": lambda s, d: _mpe(s, d)
    .select(resource_provider(F.col("target_resource_id")).alias("provider"))
    .groupBy("provider")
    .agg(F.count("*").alias("endpoints"))
    .withColumn("api_version", api_version(F.col("provider"))),
    "mpe_logical_keys": lambda s, d: _mpe(s, d).select(logical_key(F.col("workspace_id"), F.col("mpe_name")).alias("logical_key")).groupBy("logical_key").agg(F.count("*").alias("readings")),
    "mpe_listing": lambda s, d: _mpe(s, d).select("workspace_name", "mpe_name", *_FEW).distinct().orderBy("workspace_name", "mpe_name", "collected_at"),
    "mpe_run_times": lambda s, d: _mpe(s, d).groupBy("run_label").agg(run_label(F.min("collected_at")).alias("started"), run_label(F.max("collected_at")).alias("ended"), F.count("*").alias("readings")),
    "mpe_pending": lambda s, d: pending(
        _mpe(s, d).select("workspace_id", "mpe_id", "run_label", F.to_json(F.struct(F.struct(F.struct(F.col("connection_status").alias("status"), F.col("connection_description").alias("description")).alias("privateLinkServiceConnectionState")).alias("properties"))).alias("body")), "body", "ticket"
    ).select("workspace_id", "mpe_id", "run_label"),
    "lifecycle_chain": lifecycle_chain,
    "recreate_failures": recreate_failures,
    "deletions_audited": deletions_audited,
    "recreations_audited": recreations_audited,
    "approvals_audited": approvals_audited,
    "mpe_allowed": lambda s, d: matching(_mpe(s, d).select(*_FEW), workspaces=table(s, d, "dim_workspace").where("capacity_id IS NOT NULL AND deleted_at IS NULL")),
    "failures_by_provider": failures_by_provider,
}

_COLS = ", ".join(_FEW)
_PROVIDER = "nullif(regexp_extract(target_resource_id, '/providers/([^/]*/[^/]*)', 1), '')"
_D = "(SELECT c_custkey AS mpe_id, c_name AS mpe_name, 200 + c_custkey % 4 * 67 AS delete_status FROM customer)"
_R = "(SELECT o_custkey AS original_mpe_id, o_orderkey AS new_mpe_id, o_orderdate AS created_at, 200 + o_orderkey % 5 * 60 AS create_status FROM orders)"
ORACLE = {
    "mpe_by_subresource": f"SELECT target_subresource_type, count(*) AS endpoints FROM {T} GROUP BY 1",
    "mpe_by_states": f"SELECT provisioning_state, connection_status, count(*) AS endpoints FROM {T} GROUP BY 1, 2",
    "mpe_filtered": f"SELECT {_COLS}, mpe_name, target_resource_id FROM {T} WHERE regexp_matches(coalesce(mpe_name, ''), '(?i)^pe-(blob|vault)-') AND regexp_matches(coalesce(target_resource_id, ''), '/providers/(blob|vault)/')",
    "mpe_latest_in": f"SELECT {_COLS} FROM {T} WHERE (workspace_id, mpe_id, collected_at) IN (SELECT workspace_id, mpe_id, max(collected_at) FROM {T} GROUP BY 1, 2)",
    "mpe_latest_max_by": f"SELECT {_COLS} FROM {T} QUALIFY row_number() OVER (PARTITION BY workspace_id, mpe_id ORDER BY collected_at DESC NULLS LAST, provisioning_state DESC NULLS LAST, connection_status DESC NULLS LAST, run_label DESC NULLS LAST) = 1",
    "mpe_latest_row_number": f"SELECT {_COLS} FROM {T} QUALIFY row_number() OVER (PARTITION BY workspace_id, mpe_id ORDER BY collected_at DESC NULLS LAST, provisioning_state DESC NULLS LAST, connection_status DESC NULLS LAST, run_label DESC NULLS LAST) = 1",
    "mpe_recent": f"SELECT {_COLS} FROM {T} WHERE collected_at > TIMESTAMPTZ '2025-12-10 00:00:00+00' - INTERVAL 7 DAYS",
    "mpe_run_workspaces": f"SELECT DISTINCT workspace_id FROM {T} WHERE run_label = 'inv-20250106'",
    "mpe_providers": f"SELECT {_PROVIDER} AS provider, count(*) AS endpoints, '2023-09-01' AS api_version FROM {T} GROUP BY 1",
    "mpe_logical_keys": f"SELECT translate(concat_ws('_', substring(workspace_id, 1, 8), mpe_name), '- ', '__') AS logical_key, count(*) AS readings FROM {T} GROUP BY 1",
    "mpe_listing": f"SELECT DISTINCT workspace_name, mpe_name, {_COLS} FROM {T}",
    "mpe_run_times": f"SELECT run_label, strftime(min(collected_at) AT TIME ZONE 'UTC', '%Y-%m-%d_%H-%M-%S') AS started, strftime(max(collected_at) AT TIME ZONE 'UTC', '%Y-%m-%d_%H-%M-%S') AS ended, count(*) AS readings FROM {T} GROUP BY 1",
    "mpe_pending": f"SELECT workspace_id, mpe_id, run_label FROM {T} WHERE lower(connection_status) = 'pending' AND contains(connection_description, 'ticket')",
    "lifecycle_chain": f"""SELECT d.mpe_id, d.mpe_name, d.delete_status, r.new_mpe_id, r.created_at, r.create_status, l_linenumber AS attempt, l_shipdate AS approved_at, l_linestatus AS new_connection_state
        FROM {_D} d LEFT JOIN {_R} r ON r.original_mpe_id = d.mpe_id LEFT JOIN lineitem ON l_orderkey = r.new_mpe_id WHERE d.delete_status BETWEEN 200 AND 299""",
    "deletions_audited": f"SELECT * FROM {_D}",
    "recreations_audited": f"SELECT mpe_name, original_mpe_id, new_mpe_id, create_status, created_at FROM {_R} LEFT JOIN {_D} ON mpe_id = original_mpe_id",
    "approvals_audited": f"SELECT l_orderkey AS approved_mpe_id, original_mpe_id, l_linenumber AS attempt, l_linestatus AS new_connection_state, l_shipdate AS approved_at FROM lineitem LEFT JOIN {_R} ON l_orderkey = new_mpe_id",
    "mpe_allowed": f"SELECT {_COLS} FROM {T} WHERE workspace_id IN (SELECT workspace_id FROM dim_workspace WHERE capacity_id IS NOT NULL AND deleted_at IS NULL)",
    "recreate_failures": f"SELECT * FROM {_R} WHERE create_status >= 400",
    "failures_by_provider": "SELECT event_type AS target_rp, count(*) AS failed, min(s) AS first_status FROM (SELECT event_type, 200 + CAST(json_extract_string(props, '$.k') AS INTEGER) * 40 AS s FROM events) WHERE s >= 400 GROUP BY 1",
}
