"""The rule scan, chunks and the scalar functions over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import urls
from tessera.functions.jsons import definition_details, patch_payload, replace_values
from tessera.functions.paths import attribute, is_content_part, item_paths, part_name
from tessera.functions.quantiles import exclusive_quantiles
from tessera.functions.rule_catalogue import RULES
from tessera.functions.severity import meets
from tessera.operators.blocks import blocks
from tessera.operators.chunking import chunk_documents
from tessera.operators.first_generation import scan_texts
from tessera.operators.latest import first_by_window, upsert
from tessera.operators.scan import rule_hits, scan_documents
from tessera.plans.findings import review_queue
from tessera.session import table

#: RE2 has no look-behind: the SQL leaves out the rules that need one, the queries count them.
_PORTABLE = tuple(r for r in RULES if "(?<" not in r.regex)


def _once(df: DataFrame, key: str) -> DataFrame:
    """Repeated rows once, spread over as many tasks as a shuffle has: what follows is bound by computing, not by bytes, so it must not be coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).distinct()


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebook sources once each, with a path whose ending tells the container."""
    n = _once(table(spark, sf_dir, "notebook_sources").select("source_id", "workspace_id", "workspace_name", "display_name", "notebook_id", "source_text"), "source_id")
    ending = F.when(F.ltrim("source_text").startswith("{"), ".ipynb").otherwise(".py")
    return n.withColumn("path", F.concat("display_name", ending))


def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every notebook source, with positions."""
    found = scan_documents(_sources(spark, sf_dir), "source_id", "path", "source_text")
    return found.select("source_id", "cell_index", "line_number", "source_kind", "finding_type", "category", "severity", "message", "code_snippet", "url", "direction", "error")


def scanned_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue over freshly scanned sources."""
    s = _sources(spark, sf_dir)
    found = scan_documents(s, "source_id", "path", "source_text").join(s.select("source_id", "workspace_name", "display_name", "notebook_id"), "source_id").withColumn("cross_workspace", F.lit(None).cast("boolean"))
    return review_queue(found)


def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and documents of each rule, counted in the JVM."""
    s = _once(table(spark, sf_dir, "notebook_sources").select("source_id", "source_text"), "source_id")
    return rule_hits(s, "source_id", "source_text").groupBy("rule").agg(F.sum("hits").alias("hits"), F.count("*").alias("documents"))


def snippet_rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _once(table(spark, sf_dir, "fabric_url_scanner").select("row_id", "match_snippet"), "row_id")
    return rule_hits(s, "row_id", "match_snippet").groupBy("rule").agg(F.sum("hits").alias("hits"), F.count("*").alias("documents"))


def secret_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a generic secret assignment, by source."""
    rule = next(r for r in RULES if r.message == "Generic secret assignment")
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(f"(?d){rule.inline}"))
    return d.groupBy("source").agg(F.count("*").alias("documents"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(_sources(spark, sf_dir), "source_id", "path", "source_text")


def block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every notebook source."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = [(k, b.cell_index, b.source_kind, len(b.text)) for k, p, t in zip(pdf["source_id"], pdf["path"], pdf["source_text"]) for b in blocks(t or "", p or "")]
            yield pd.DataFrame(rows, columns=["source_id", "cell_index", "source_kind", "characters"])

    return _sources(spark, sf_dir).select("source_id", "path", "source_text").mapInPandas(run, "source_id long, cell_index int, source_kind string, characters int")


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scan_results").select("result_id", "code_snippet").distinct()


def redacted_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c: Column = F.col("code_snippet")
    return _snippets(spark, sf_dir).select("result_id", tx.redact(c).alias("redacted"), tx.trim_snippet(c, 40).alias("short"))


def snippet_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snippets(spark, sf_dir).where("code_snippet IS NOT NULL").select("result_id", F.round(tx.entropy(F.col("code_snippet")), 6).alias("entropy"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded and actual hash and length of every notebook source."""
    n = table(spark, sf_dir, "notebook_sources").select("source_id", "content_hash", "content_length", "source_text").distinct()
    return n.select("source_id", tx.content_hash16(F.col("source_text")).alias("actual_hash"), F.col("content_hash").alias("recorded_hash"), F.length("source_text").cast("long").alias("actual_length"), F.col("content_length").alias("recorded_length"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "dim_workspace").select("workspace_id", "workspace_name").distinct()
    return w.select("workspace_id", tx.safe_segment(F.col("workspace_name"), 12).alias("segment")).distinct()


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destination named by each address, resolved by id or name, and whether it lies elsewhere."""
    f = table(spark, sf_dir, "fabric_url_scanner").where("url IS NOT NULL").select("row_id", "workspace_id", "workspace_name", "url").distinct()
    generic = F.coalesce(F.nullif(F.regexp_extract("url", r"(?i)abfss?://([^@/\s]+)@", 1), F.lit("")), F.nullif(F.regexp_extract("url", r"(?i)/workspaces/([0-9a-f-]{8,})", 1), F.lit("")))
    f = f.withColumn("raw", F.coalesce(urls.destination(F.col("url")), generic))
    w = table(spark, sf_dir, "dim_workspace").where("workspace_name IS NOT NULL")
    names = w.groupBy(F.lower("workspace_id").alias("id_key")).agg(F.min("workspace_name").alias("name_of_id"))
    ids = w.groupBy(F.lower("workspace_name").alias("name_key")).agg(F.min(F.lower("workspace_id")).alias("id_of_name"))
    j = f.join(names, F.lower("raw") == F.col("id_key"), "left").join(ids, F.lower("raw") == F.col("name_key"), "left")
    id_, name, cross = urls.resolve(F.col("raw"), F.col("name_of_id"), F.col("id_of_name"), F.col("workspace_id"), F.col("workspace_name"))
    return j.select("row_id", id_.alias("dest_id"), name.alias("dest_name"), cross.alias("cross_workspace"))


def path_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspace and date read off export paths: of two kinds of folders, and of none."""
    n = table(spark, sf_dir, "scan_results").select("result_id", "workspace_id", "source_dated_partition", "display_name").distinct()
    date = F.replace(F.coalesce("source_dated_partition", F.lit("nodate")), F.lit("-"), F.lit(""))
    path = F.when(F.col("result_id") % 3 == 0, F.concat_ws("/", F.lit("/base"), F.lit("team"), date, F.col("display_name"))).otherwise(F.concat_ws("/", F.lit("/x/notebook_exports"), F.coalesce("workspace_id", F.lit("none")), date, F.col("display_name")))
    p = n.withColumn("path", path)
    id_, name, dated = attribute(F.col("path"), base="/base", default_id="lakehouse", default_name="Lakehouse")
    return p.select("result_id", id_.alias("path_workspace"), name.alias("path_name"), dated.alias("path_date"), tx.base_name(F.col("path")).alias("file"))


def latest_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest dated partition of every workspace."""
    return table(spark, sf_dir, "scan_results").where("source_dated_partition IS NOT NULL").groupBy("workspace_id").agg(F.max("source_dated_partition").alias("latest"))


def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fact_scan_findings")
    return f.where(meets(F.col("severity"), "high")).groupBy("severity").agg(F.count("*").alias("n"))


def item_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "item_inventory").select("item_id", "display_name", "item_type", "workspace_id", "workspace_name").distinct()
    mode = F.when(F.lower("item_type") == "lakehouse", "parts").otherwise("py")
    primary, record = item_paths(F.lit("/out"), F.lit("run-1"), F.coalesce("workspace_id", F.lit("")), F.col("workspace_name"), F.col("item_type"), F.col("item_id"), F.col("display_name"), mode)
    return i.select("item_id", "workspace_id", "workspace_name", "display_name", primary.alias("primary_target"), record.alias("item_json_target"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "fabric_url_scanner").select("part_path").distinct()
    return p.select("part_path", part_name(F.concat(F.lit("/.platform/"), F.coalesce("part_path", F.lit("")))).alias("file_name"), is_content_part(F.col("part_path")).alias("is_content"))


def load_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive p50, p95 and p99 of the events' values per kind."""
    return exclusive_quantiles(table(spark, sf_dir, "events"), "value", (0.5, 0.95, 0.99), ["event_type"])


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rate and extremes per kind of event, and the same of all together."""
    e = table(spark, sf_dir, "events").withColumn("spoke", F.explode(F.array("event_type", F.lit("(all)"))))
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)
    return e.groupBy("spoke").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.count("*") / seconds, 6).alias("rate"), F.max("value").alias("longest"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspaces after an upsert of the later half of their rows with changed names."""
    w = table(spark, sf_dir, "dim_workspace").select("workspace_id", "workspace_name", "capacity_id", "last_seen")
    one = first_by_window(w, ["workspace_id"], [F.desc_nulls_last("last_seen"), F.desc_nulls_last("workspace_name"), F.desc_nulls_last("capacity_id")])
    changes = one.where("last_seen >= timestamp'2025-06-01 00:00:00'").withColumn("workspace_name", F.concat(F.lit("* "), F.coalesce("workspace_name", F.lit(""))))
    return upsert(one, changes.unionByName(changes), "workspace_id", "last_seen")


def replaced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind replaced in JSON values but not in their keys."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"click":"'), "event_type", F.lit('","list":["'), "event_type", F.lit('",1]}')).alias("t"))
    return e.select("event_id", replace_values(F.col("t"), {"click": "tap"}).alias("replaced"))


def patched_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.base64(F.concat(F.lit('{"kind":"'), "event_type", F.lit('"}')).cast("binary")).alias("p"))
    return e.select("event_id", F.unbase64(patch_payload(F.col("p"), {"click": "tap"})).cast("string").alias("patched"))


def definition_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections that the notebook sources name, with their direction."""
    return definition_details(_once(table(spark, sf_dir, "notebook_sources").select("source_id", "source_text"), "source_id"), "source_id", "source_text")


def first_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the first generation's scan of every notebook source."""
    return scan_texts(_sources(spark, sf_dir), "source_id", "path", "source_text")


def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of what was fetched; events stand for the fetched records."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.agg(F.count("*").alias("fetched"), F.round(F.sum("value"), 4).alias("total_value"), F.sum(k).alias("total_k"), F.countDistinct("event_type").alias("kinds"), F.countDistinct("user_id").alias("users"))


def instance_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("n"))


def flow_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scan_results").select(tx.flow_direction(F.col("code_snippet")).alias("flow")).groupBy("flow").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_scan, scanned_queue, rule_totals, snippet_rule_totals, secret_by_source, chunks, block_extract, redacted_snippets, snippet_entropy, content_hashes, safe_names, destinations,
        path_attribution, latest_dated, severity_threshold, item_targets, part_names, load_quantiles, load_summary, upserted, replaced_values, patched_payloads, definition_refs, flow_directions, first_scan, fetch_summary, instance_distribution,
    )
}


def _sql_rules(table_: str, key: str, text: str) -> str:
    quoted = lambda s: s.replace("'", "''")
    each = " UNION ALL ".join(f"SELECT {r.number} AS rule, len(regexp_extract_all({text}, '{quoted(r.inline)}')) AS n FROM t" for r in _PORTABLE)
    return f"WITH t AS (SELECT DISTINCT {key}, {text} FROM {table_} WHERE {text} IS NOT NULL), h AS ({each}) SELECT CAST(rule AS INTEGER) AS rule, CAST(sum(n) AS BIGINT) AS hits, count(*) AS documents FROM h WHERE n > 0 GROUP BY 1"


_GENERIC = next(r for r in RULES if r.message == "Generic secret assignment").inline.replace("'", "''")
_SAFE = "coalesce(nullif(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'unnamed')"
_Q = "v[CAST(least(greatest(floor({p} * (n + 1)), 1), n) AS INTEGER)] + least(greatest({p} * (n + 1) - least(greatest(floor({p} * (n + 1)), 1), n), 0), 1) * (v[CAST(least(least(greatest(floor({p} * (n + 1)), 1), n) + 1, n) AS INTEGER)] - v[CAST(least(greatest(floor({p} * (n + 1)), 1), n) AS INTEGER)])"
_W = "SELECT workspace_id, workspace_name, capacity_id, last_seen FROM dim_workspace QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY last_seen DESC NULLS LAST, workspace_name DESC NULLS LAST, capacity_id DESC NULLS LAST) = 1"
_GUID = "'^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$', 'i'"
_BRANCHES = ", ".join(f"nullif(regexp_extract(url, '{p}', 1), '')" for p in urls.DESTINATIONS)
_FLOW = "regexp_matches(lower(coalesce(code_snippet, '')), '{0}')"
ORACLE = {
    "fetch_summary": "SELECT count(*) AS fetched, round(sum(value), 4) AS total_value, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS total_k, count(DISTINCT event_type) AS kinds, count(DISTINCT user_id) AS users FROM events WHERE event_type <> 'error'",
    "instance_distribution": "SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1",
    "rule_totals": _sql_rules("notebook_sources", "source_id", "source_text"),
    "snippet_rule_totals": _sql_rules("fabric_url_scanner", "row_id", "match_snippet"),
    "secret_by_source": f"SELECT source, count(*) AS documents FROM documents WHERE regexp_matches(text, '{_GENERIC}') GROUP BY 1",
    "redacted_snippets": """SELECT DISTINCT result_id, CASE WHEN code_snippet = '' THEN code_snippet WHEN length(trim(code_snippet)) <= 11 THEN '***' ELSE left(trim(code_snippet), 4) || repeat('*', CAST(length(trim(code_snippet)) - 8 AS BIGINT)) || right(trim(code_snippet), 4) END AS redacted,
        CASE WHEN length(trim(coalesce(code_snippet, ''))) <= 40 THEN trim(coalesce(code_snippet, '')) ELSE left(trim(code_snippet), 39) || '…' END AS short FROM scan_results""",
    "snippet_entropy": "SELECT DISTINCT result_id, round(CASE WHEN code_snippet = '' THEN 0 ELSE list_aggregate(string_split(code_snippet, ''), 'entropy') END, 6) AS entropy FROM scan_results WHERE code_snippet IS NOT NULL",
    "content_hashes": "SELECT DISTINCT source_id, CASE WHEN coalesce(source_text, '') = '' THEN '' ELSE left(sha256(source_text), 16) END AS actual_hash, content_hash AS recorded_hash, length(source_text) AS actual_length, content_length AS recorded_length FROM notebook_sources",
    "safe_names": f"SELECT DISTINCT workspace_id, left({_SAFE.format('workspace_name')}, 12) AS segment FROM (SELECT DISTINCT workspace_id, workspace_name FROM dim_workspace)",
    "destinations": f"""WITH f AS (SELECT DISTINCT row_id, workspace_id, workspace_name, url, coalesce({_BRANCHES}, nullif(regexp_extract(url, '(?i)abfss?://([^@/\\s]+)@', 1), ''), nullif(regexp_extract(url, '(?i)/workspaces/([0-9a-f-]{{8,}})', 1), '')) AS raw FROM fabric_url_scanner WHERE url IS NOT NULL),
        names AS (SELECT lower(workspace_id) AS k, min(workspace_name) AS v FROM dim_workspace WHERE workspace_name IS NOT NULL GROUP BY 1), ids AS (SELECT lower(workspace_name) AS k, min(lower(workspace_id)) AS v FROM dim_workspace WHERE workspace_name IS NOT NULL GROUP BY 1),
        j AS (SELECT f.*, CASE WHEN regexp_matches(raw, {_GUID}) THEN lower(raw) ELSE ids.v END AS dest_id, CASE WHEN regexp_matches(raw, {_GUID}) THEN names.v ELSE raw END AS dest_name FROM f LEFT JOIN names ON lower(raw) = names.k LEFT JOIN ids ON lower(raw) = ids.k)
        SELECT row_id, nullif(dest_id, '') AS dest_id, nullif(dest_name, '') AS dest_name, CASE WHEN coalesce(dest_id, '') <> '' AND regexp_matches(workspace_id, {_GUID}) THEN dest_id <> lower(workspace_id)
          WHEN coalesce(dest_name, '') <> '' AND coalesce(workspace_name, '') <> '' THEN lower(dest_name) <> lower(workspace_name) END AS cross_workspace FROM j""",
    "path_attribution": """WITH n AS (SELECT DISTINCT result_id, workspace_id, source_dated_partition, display_name FROM scan_results),
        p AS (SELECT *, CASE WHEN result_id % 3 = 0 THEN concat_ws('/', '/base', 'team', replace(coalesce(source_dated_partition, 'nodate'), '-', ''), display_name) ELSE concat_ws('/', '/x/notebook_exports', coalesce(workspace_id, 'none'), replace(coalesce(source_dated_partition, 'nodate'), '-', ''), display_name) END AS path FROM n),
        q AS (SELECT *, '/([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})/(\\d{8}[^/]*)/' AS dated FROM p),
        r AS (SELECT *, coalesce(nullif(regexp_extract(path, '/base/([^/]+)/([^/]+)/', 1), ''), nullif(regexp_extract(path, '/([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})/(\\d{8}[^/]*)/', 1), '')) AS i,
          coalesce(nullif(regexp_extract(path, '/base/([^/]+)/([^/]+)/', 2), ''), nullif(regexp_extract(path, '/([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})/(\\d{8}[^/]*)/', 2), '')) AS d FROM q)
        SELECT result_id, coalesce(i, 'lakehouse') AS path_workspace, coalesce(i, 'Lakehouse') AS path_name, d AS path_date, string_split(path, '/')[-1] AS file FROM r""",
    "latest_dated": "SELECT workspace_id, max(source_dated_partition) AS latest FROM scan_results WHERE source_dated_partition IS NOT NULL GROUP BY 1",
    "severity_threshold": "SELECT severity, count(*) AS n FROM fact_scan_findings WHERE severity IS NULL OR severity NOT IN ('low', 'medium') GROUP BY 1",
    "item_targets": f"""WITH i AS (SELECT DISTINCT item_id, display_name, item_type, workspace_id, workspace_name FROM item_inventory),
        b AS (SELECT *, '/out/run-1/' || left({_SAFE.format("coalesce(nullif(workspace_name, ''), nullif(coalesce(workspace_id, ''), ''), 'unknown_ws')")}, 80) || '__' || coalesce(workspace_id, '') || '/' || left({_SAFE.format("item_type")}, 40) || '/' || left({_SAFE.format("coalesce(nullif(display_name, ''), nullif(item_id, ''))")}, 80) || '__' || item_id AS f FROM i)
        SELECT item_id, workspace_id, workspace_name, display_name, f || CASE WHEN lower(item_type) = 'lakehouse' THEN '__definition.txt' ELSE '.py' END AS primary_target, f || '.item.json' AS item_json_target FROM b""",
    "part_names": "SELECT DISTINCT part_path, coalesce(nullif(regexp_replace(replace(regexp_replace('/.platform/' || coalesce(part_path, ''), '^/+|/+$', '', 'g'), '/', '__'), '^\\.+', ''), ''), 'part') AS file_name, contains(lower(coalesce(part_path, '')), 'notebook-content') OR contains(lower(coalesce(part_path, '')), 'pipeline-content') OR contains(lower(coalesce(part_path, '')), 'mashup') OR lower(coalesce(part_path, '')) LIKE '%.ipynb' AS is_content FROM fabric_url_scanner",
    "load_quantiles": f"WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, {_Q.format(p='0.5::DOUBLE')} AS p50, {_Q.format(p='0.95::DOUBLE')} AS p95, {_Q.format(p='0.99::DOUBLE')} AS p99 FROM g",
    "load_summary": "SELECT spoke, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS rate, max(value) AS longest FROM (SELECT *, unnest([event_type, '(all)']) AS spoke FROM events) GROUP BY 1",
    "upserted": f"WITH one AS ({_W}) SELECT workspace_id, CASE WHEN last_seen >= TIMESTAMPTZ '2025-06-01 00:00:00+00' THEN '* ' || coalesce(workspace_name, '') ELSE workspace_name END AS workspace_name, capacity_id, last_seen FROM one",
    "replaced_values": """SELECT event_id, CASE WHEN event_type = 'click' THEN '{"click":"tap","list":["tap",1]}' ELSE '{"click":"' || event_type || '","list":["' || event_type || '",1]}' END AS replaced FROM events""",
    "patched_payloads": """SELECT event_id, '{"kind":"' || replace(event_type, 'click', 'tap') || '"}' AS patched FROM events""",
    "flow_directions": f"SELECT CASE WHEN {_FLOW.format('sink|destination|output|write|copy into|target')} AND {_FLOW.format('source|input|read|origin|from')} THEN 'both' WHEN {_FLOW.format('sink|destination|output|write|copy into|target')} THEN 'sink' WHEN {_FLOW.format('source|input|read|origin|from')} THEN 'source' ELSE 'unknown' END AS flow, count(*) AS n FROM scan_results GROUP BY 1",
}
