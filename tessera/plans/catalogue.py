"""Star schema, item catalogue, splits and deep scans over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_id
from tessera.functions.severity import SEVERITY_ROWS
from tessera.operators.datasources import artifacts, placeholders, using
from tessera.operators.downloads import classified, item_files, manifest, parts, resolve_types, split_plan
from tessera.operators.latest import first_by_window
from tessera.session import table

#: Tables of the star schema and their keys.
STAR = {
    "fact_scan_findings": ("finding_id", "finding_id string, scan_run_id string, workspace_id string, source_dated_partition string, notebook_id string, severity string, kind string, redacted_snippet string, url string, detected_at timestamp"),
    "fact_downloads": ("download_id", "download_id string, run_id string, workspace_id string, item_id string, item_type string, format string, downloaded_at timestamp, bytes int, sha256 string"),
    "fact_mpe_lifecycle": ("event_id", "event_id string, workspace_id string, mpe_id string, target_resource_id string, action string, actor string, timestamp timestamp"),
    "dim_workspace": ("workspace_id", "workspace_id string, workspace_name string, capacity_id string, last_seen timestamp"),
    "dim_item_type": ("item_type", "item_type string, family string"),
    "dim_severity": ("severity", "severity string, ordinal int, color string"),
}


def finding_key(*columns: str):
    """A key that is the same whenever the same finding is exported again."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)


def finding_facts(findings: DataFrame, run: str) -> DataFrame:
    """Facts of a findings frame: rows that are findings, once each, under a stable key."""
    f = findings.where("finding_type IS NOT NULL")
    key = finding_key("workspace_id", "notebook_id", "cell_index", "line_number", "finding_type", "category", "message")
    return f.select(key.alias("finding_id"), F.lit(run).alias("scan_run_id"), "workspace_id", "source_dated_partition", "notebook_id", "severity", F.col("finding_type").alias("kind"), F.col("code_snippet").alias("redacted_snippet"), "url", F.col("scanned_at").alias("detected_at")).groupBy("finding_id").agg(
        *[F.min(c).alias(c) for c in ("scan_run_id", "workspace_id", "source_dated_partition", "notebook_id", "severity", "kind", "redacted_snippet", "url", "detected_at")]
    )


def split_valid(rows: DataFrame, key: str, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check (and have a key), and the others with the names of the checks they fail."""
    failed = F.array_compact(F.array(F.when(F.col(key).isNull(), F.lit(f"{key} is missing")), *[F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(n)) for n, c in checks.items()]))
    judged = rows.withColumn("failed", failed)
    return judged.where(F.size("failed") == 0).drop("failed"), judged.where(F.size("failed") > 0)


def star_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per capacity and severity, with the severities' order; workspaces are taken once."""
    w = table(spark, sf_dir, "dim_workspace").select(canonical_id(F.col("workspace_id")).alias("id"), "capacity_id", "last_seen")
    one = first_by_window(w, ["id"], [F.desc_nulls_last("last_seen"), F.desc_nulls_last("capacity_id")])
    s = spark.createDataFrame(SEVERITY_ROWS, "name string, ordinal int, color string")
    f = table(spark, sf_dir, "fact_scan_findings").select("finding_id", canonical_id(F.col("workspace_id")).alias("ws"), F.lower("severity").alias("severity")).distinct()
    j = f.join(one, f["ws"] == one["id"], "left").join(s, f["severity"] == s["name"], "left")
    return j.groupBy("capacity_id", "severity", "ordinal").agg(F.count("*").alias("findings"))


def severity_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(SEVERITY_ROWS, STAR["dim_severity"][1])


_CHECKS = {"unknown severity": "severity IN ('critical', 'high', 'medium', 'low')", "no time": "detected_at IS NOT NULL", "unknown kind": "kind = lower(kind)"}


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that can't be loaded, by what is wrong with them."""
    bad = split_valid(table(spark, sf_dir, "fact_scan_findings"), "finding_id", _CHECKS)[1]
    return bad.select(F.explode("failed").alias("check_name")).groupBy("check_name").agg(F.count("*").alias("n"))


def exported_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_facts(table(spark, sf_dir, "scan_results"), "run-1").groupBy("kind", "severity").agg(F.count("*").alias("facts"), F.countDistinct("finding_id").alias("keys"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "item_inventory")


def item_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_types(_items(spark, sf_dir), None, ["LAKEHOUSE "])


def plan_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).select("item_id", "item_type", "display_name", "workspace_id").distinct()
    return split_plan(classified(i, ["lakehouse"]), "ws-a", "ws-b", "ws-source")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of_split(spark, sf_dir).groupBy("target_workspace", "action").agg(F.count("*").alias("items"))


def first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item once: the first seen, as listed."""
    i = _items(spark, sf_dir).select(canonical_id(F.col("item_id")).alias("item"), "display_name", "workspace_id", "first_seen")
    return first_by_window(i, ["item"], [F.asc_nulls_last("first_seen"), F.asc_nulls_last("display_name"), F.asc_nulls_last("workspace_id")])


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes made of the notebook sources, the case chosen by their number: no body at all, a main part of another name or language, an empty or a second source part beside it, and every export mode."""
    n = table(spark, sf_dir, "notebook_sources").select("workspace_id", "workspace_name", F.col("source_id").cast("string").alias("item_id"), "display_name", "source_text", "exported_at").distinct()
    k, part = F.col("item_id").cast("long"), lambda name, payload: F.concat(F.lit('{"path":"'), name, F.lit('","payload":"'), payload, F.lit('","payloadType":"InlineBase64"}'))
    payload = F.replace(F.base64(F.encode("source_text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    name = F.when(k % 4 == 0, "other.txt").when(k % 4 == 1, "/notebook-content.sql").otherwise("notebook-content.py")
    beside = F.when(k % 3 == 0, F.concat(F.lit(","), part(F.lit("empty.json"), F.lit("")))).otherwise(""), F.when(k % 11 == 0, F.concat(F.lit(","), part(F.lit("notebook-content.r"), F.lit("eA==")))).otherwise("")
    body = F.concat(F.lit('{"definition":{"parts":['), part(name, payload), *beside, F.lit("]}}"))
    mode = F.element_at(F.array(*map(F.lit, ("txt", "parts", "ipynb", "py", "py"))), (k % 5 + 1).cast("int"))
    return n.withColumn("body", F.when(k % 7 != 0, body)).withColumn("item_type", F.lit("Notebook")).withColumn("export_format", mode)


def base64_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(_envelopes(spark, sf_dir).select("item_id", "body"), "body")
    return p.select("item_id", "part_index", "part_path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def download_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a run after which every ninth item's main target is there already."""
    made = lambda there=None: manifest(_envelopes(spark, sf_dir), "body", F.lit("/out"), F.lit("run-1"), F.col("exported_at"), there)
    there = made().where((F.col("item_id").cast("long") % 9 == 0) & (F.col("status") == "ok")).select(F.col("primary_target").alias("path"))
    return made(there).select("item_id", "export_format", "part_count", "parts_saved", "has_content_part", "payload_bytes", "sha256", "http_status", "status", "error", "downloaded_at")


def handled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of the envelopes by the handlers of four types."""
    kinds = F.array(*map(F.lit, ("Notebook", "lakehouse", "Report", "Unheard")))
    items = _envelopes(spark, sf_dir).select("item_id", F.element_at(kinds, (F.col("item_id").cast("long") % 13 % 4 + 1).cast("int")).alias("item_type"), "body")
    return item_files(items, "body").select("item_id", "item_type", "file_name", F.when(F.col("item_type") != "lakehouse", F.length("content")).alias("bytes"))


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned workspaces made of the item inventory: every item a dataset that uses an instance named by its id's first digit."""
    i = _items(spark, sf_dir).select("workspace_id", canonical_id(F.col("item_id")).alias("item"), "display_name").distinct().where("workspace_id IS NOT NULL AND item IS NOT NULL")
    data = F.struct(F.col("item").alias("id"), F.col("display_name").alias("name"), F.array(F.struct(F.concat(F.lit("DS-"), F.upper(F.substring("item", 1, 1))).alias("datasourceInstanceId"))).alias("datasourceUsages"))
    return i.groupBy("workspace_id").agg(F.collect_set(data).alias("datasets")).select("workspace_id", F.to_json(F.struct(F.col("workspace_id").alias("id"), F.col("workspace_id").alias("name"), "datasets")).alias("body"))


def deep_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _scans(spark, sf_dir)
    targets = spark.createDataFrame([("DS-A",), ("ds-7",)], "target string")
    found = placeholders(scans, using(artifacts(scans, "body"), targets, "target"))
    return found.select("workspace_id", "artifact_type", "artifact_id", "artifact_name", F.array_join("matched", "|").alias("matched"))


QUERIES = {f.__name__: f for f in (star_dim_join, severity_seeds, quarantine, exported_facts, item_types, plan_of_split, split_counts, first_items, base64_parts, download_manifest, handled_files, deep_scan)}


def _sql_id(c: str) -> str:
    h = f"lower(regexp_replace({c}, '[^0-9A-Fa-f]', '', 'g'))"
    return f"CASE WHEN length({h}) = 32 THEN regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') WHEN trim({c}) <> '' THEN lower(trim({c})) END"


_PLAN = """WITH i AS (SELECT DISTINCT item_id, item_type, display_name, workspace_id FROM item_inventory WHERE coalesce(item_id, '') <> ''),
c AS (SELECT *, CASE WHEN lower(trim(coalesce(item_type, ''))) = 'lakehouse' THEN 'A' ELSE 'B' END AS target_workspace FROM i),
p AS (SELECT item_id, coalesce(item_type, '') AS item_type, coalesce(nullif(display_name, ''), item_id) AS name, 'ws-source' AS source_workspace_id, target_workspace, CASE target_workspace WHEN 'A' THEN 'ws-a' ELSE 'ws-b' END AS target_workspace_id,
  CASE WHEN CASE target_workspace WHEN 'A' THEN 'ws-a' ELSE 'ws-b' END = coalesce(nullif(workspace_id, ''), 'ws-source') THEN 'leave' ELSE 'move' END AS action FROM c)
"""
_N = "WITH n AS (SELECT DISTINCT source_id AS k, CAST(source_id AS VARCHAR) AS item_id, source_text AS t, exported_at FROM notebook_sources)"
_N += """, c AS (SELECT *, k % 7 <> 0 AND t IS NOT NULL AS b, k % 11 = 0 AS r, CASE k % 4 WHEN 0 THEN 'other.txt' WHEN 1 THEN '/notebook-content.sql' ELSE 'notebook-content.py' END AS nm, ['txt', 'parts', 'ipynb', 'py', 'py'][k % 5 + 1] AS mode,
    1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS parts, CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS src FROM n)"""
ORACLE = {
    "star_dim_join": f"""WITH w AS (SELECT {_sql_id("workspace_id")} AS id, capacity_id, last_seen FROM dim_workspace), one AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST, capacity_id DESC NULLS LAST) = 1),
        s AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {o})" for n, o, _ in SEVERITY_ROWS)}) v(name, ordinal)), f AS (SELECT DISTINCT finding_id, {_sql_id("workspace_id")} AS ws, lower(severity) AS severity FROM fact_scan_findings)
        SELECT capacity_id, f.severity, ordinal, count(*) AS findings FROM f LEFT JOIN one ON f.ws = one.id LEFT JOIN s ON f.severity = s.name GROUP BY 1, 2, 3""",
    "severity_seeds": f"SELECT * FROM (VALUES {', '.join(str(r) for r in SEVERITY_ROWS)}) v(severity, ordinal, color)",
    "quarantine": "SELECT check_name, count(*) AS n FROM (SELECT unnest([CASE WHEN finding_id IS NULL THEN 'finding_id is missing' END, CASE WHEN NOT coalesce(severity IN ('critical', 'high', 'medium', 'low'), true) THEN 'unknown severity' END, CASE WHEN detected_at IS NULL THEN 'no time' END, CASE WHEN NOT coalesce(kind = lower(kind), true) THEN 'unknown kind' END]) AS check_name FROM fact_scan_findings) WHERE check_name IS NOT NULL GROUP BY 1",
    "exported_facts": "SELECT kind, severity, count(*) AS facts, count(*) AS keys FROM (SELECT min(finding_type) AS kind, min(severity) AS severity FROM scan_results WHERE finding_type IS NOT NULL GROUP BY workspace_id, notebook_id, cell_index, line_number, finding_type, category, message) GROUP BY 1, 2",
    "item_types": "SELECT DISTINCT item_type FROM item_inventory WHERE lower(trim(item_type)) <> 'lakehouse'",
    "plan_of_split": _PLAN + "SELECT * FROM p",
    "split_counts": _PLAN + "SELECT target_workspace, action, count(*) AS items FROM p GROUP BY 1, 2",
    "first_items": f"SELECT item, display_name, workspace_id, first_seen FROM (SELECT {_sql_id('item_id')} AS item, display_name, workspace_id, first_seen FROM item_inventory) QUALIFY row_number() OVER (PARTITION BY item ORDER BY first_seen NULLS LAST, display_name NULLS LAST, workspace_id NULLS LAST) = 1",
    "base64_parts": _N + """ SELECT item_id, CAST(0 AS INTEGER) AS part_index, ltrim(nm, '/') AS part_path, CAST(strlen(t) AS INTEGER) AS bytes, sha256(t) AS sha256 FROM c WHERE b AND strlen(t) > 0
        UNION ALL SELECT item_id, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS INTEGER), 'notebook-content.r', CAST(1 AS INTEGER), sha256('x') FROM c WHERE b AND r""",
    "handled_files": _N + """, h AS (SELECT *, ['Notebook', 'lakehouse', 'Report', 'Unheard'][k % 13 % 4 + 1] AS item_type FROM c),
        f AS (SELECT item_id, item_type, ltrim(nm, '/') AS file_name, CAST(strlen(t) AS INTEGER) AS bytes, 0 AS place FROM h WHERE b AND strlen(t) > 0 UNION ALL SELECT item_id, item_type, 'notebook-content.r', CAST(1 AS INTEGER), 1 FROM h WHERE b AND r),
        s AS (SELECT item_id, min(place) AS place FROM f WHERE file_name LIKE 'notebook-content.%' GROUP BY 1)
        SELECT item_id, item_type, file_name, bytes FROM f WHERE item_type IN ('Report', 'Unheard') UNION ALL SELECT f.item_id, item_type, file_name, bytes FROM f JOIN s ON f.item_id = s.item_id AND f.place = s.place WHERE item_type = 'Notebook'
        UNION ALL SELECT item_id, item_type, 'lakehouse_metadata.json', NULL FROM h WHERE item_type = 'lakehouse'""",
    "download_manifest": _N + """, e AS (SELECT *, CASE WHEN NOT b THEN 'no body' WHEN mode = 'ipynb' THEN 'no notebook part' WHEN mode <> 'parts' AND src = 0 THEN 'no source part' WHEN mode <> 'parts' AND src > 1 THEN 'several source parts'
            WHEN mode <> 'parts' AND k % 4 <> 0 AND strlen(t) = 0 THEN 'empty source part' END AS err, CASE WHEN k % 4 <> 0 AND strlen(t) > 0 THEN t END AS own, CASE WHEN strlen(t) > 0 THEN 1 ELSE 0 END + CASE WHEN r THEN 1 ELSE 0 END AS files FROM c),
        g AS (SELECT *, k % 9 = 0 AND err IS NULL AND (mode <> 'parts' OR files > 0) AS there, CASE WHEN mode = 'parts' THEN CASE WHEN r THEN 'x' ELSE own END WHEN r THEN coalesce(own, 'x') ELSE own END AS main FROM e),
        s AS (SELECT *, CASE WHEN err IS NOT NULL THEN 0 WHEN mode <> 'parts' THEN CASE WHEN there THEN 0 ELSE 1 END ELSE files - CASE WHEN there AND main IS NOT NULL THEN 1 ELSE 0 END END AS saved,
            CASE WHEN mode = 'parts' AND there THEN CASE WHEN r THEN own END ELSE main END AS kept FROM g)
        SELECT item_id, mode AS export_format, CAST(CASE WHEN b THEN parts ELSE 0 END AS INTEGER) AS part_count, CAST(saved AS INTEGER) AS parts_saved, CASE WHEN b THEN src > 0 END AS has_content_part, CASE WHEN err IS NULL THEN coalesce(strlen(kept), 0) ELSE 0 END AS payload_bytes,
        CASE WHEN err IS NULL THEN sha256(kept) END AS sha256, CAST(CASE WHEN b THEN 200 END AS INTEGER) AS http_status, CASE WHEN err IS NOT NULL THEN 'error' WHEN saved > 0 THEN 'ok' ELSE 'skipped_exists' END AS status,
        coalesce(err, CASE WHEN src = 0 THEN 'no content part' END) AS error, exported_at AS downloaded_at FROM s""",
    "deep_scan": f"""WITH i AS (SELECT DISTINCT workspace_id, {_sql_id("item_id")} AS item, display_name FROM item_inventory), k AS (SELECT * FROM i WHERE workspace_id IS NOT NULL AND item IS NOT NULL),
        m AS (SELECT workspace_id, 'Dataset' AS artifact_type, item AS artifact_id, display_name AS artifact_name, 'ds-' || left(item, 1) AS matched FROM k WHERE left(item, 1) IN ('a', '7')), w AS (SELECT DISTINCT workspace_id FROM k)
        SELECT w.workspace_id, artifact_type, artifact_id, coalesce(artifact_name, '(none)') AS artifact_name, matched FROM w LEFT JOIN m USING (workspace_id)""",
}
