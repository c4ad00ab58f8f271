"""Sources, sinks, streams and calls, each run end to end over the tables: what is written is read back.

Every query writes into a folder of its own below the shared checkpoint folder.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_id
from tessera.functions.text import content_hash16
from tessera.operators.fanout import call_all, outcomes
from tessera.operators.latest import current
from tessera.plans.audit import length_scorer, prompted, score, stamped
from tessera.plans.catalogue import STAR
from tessera.plans.endpoints import with_first
from tessera.session import checkpoint_dir, table
from tessera.sources import files, rest, sinks
from tessera.sources.definitions import fetched_definitions, scanned_in_batches
from tessera.streaming import ingest


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def files_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notebook source written as a file below its workspace and date, and the files scanned with what their paths tell."""
    n = table(spark, sf_dir, "notebook_sources").select("source_id", "workspace_id", "source_dated_partition", "source_text").where("source_text IS NOT NULL AND source_id IS NOT NULL").distinct()
    date = F.coalesce(F.replace("source_dated_partition", F.lit("-"), F.lit("")), F.lit("undated"))
    path = F.concat_ws("/", canonical_id(F.col("workspace_id")), date, F.concat("source_id", F.lit(".py")))
    root = folder(spark, "files")
    if not sinks.write_texts(n.select(path.alias("path"), F.col("source_text").alias("t")), "path", "t", root):
        return spark.createDataFrame([], "source_id long, workspace_id string, dated string, length long, content_hash string")
    found = files.attributed(files.binary_documents(spark, [root], "*.py"), default_id="none")
    return found.select(F.regexp_extract("path", r"(\d+)\.py$", 1).cast("long").alias("source_id"), "workspace_id", F.col("source_dated_partition").alias("dated"), "length", F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))


def rest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspaces served as linked pages of 50, read through the paged source."""
    w = table(spark, sf_dir, "dim_workspace").select("workspace_id", "workspace_name", "capacity_id").distinct()
    root = folder(spark, "pages")
    # a small fixed table: its pages are linked by number
    placed = w.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("workspace_id", "workspace_name", "capacity_id")) - 1).withColumn("page", F.floor(F.col("n") / 50))
    pages = placed.groupBy("page").agg(F.collect_list(F.struct("workspace_id", "workspace_name", "capacity_id")).alias("value"))
    count = pages.count()
    link = F.when(F.col("page") < count - 1, F.concat(F.lit(f"{root}/"), F.col("page") + 1, F.lit(".json")))
    body = F.to_json(F.struct("value", link.alias("nextLink")))
    sinks.write_texts(pages.select(F.concat("page", F.lit(".json")).alias("path"), body.alias("t")), "path", "t", root)
    rest.register(spark)
    read = spark.read.format("rest_pages").option("urls", f"{root}/0.json").option("fetcher", "tessera.sources.rest:stored").load() if count else spark.createDataFrame([], "url string, page int, record string")
    return read.select("page", F.from_json("record", "workspace_id string, workspace_name string, capacity_id string").alias("r")).select("page", "r.*")


def streamed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events arriving as files, taken in twice: the second run finds nothing new."""
    e, root = table(spark, sf_dir, "events"), folder(spark, "stream")
    e.repartition(4).write.parquet(f"{root}/in")
    for _ in range(2):
        ingest.run_once(ingest.new_documents(spark, f"{root}/in", e.schema, 2), f"{root}/state", ingest.append_batches(f"{root}/out")).awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the events per day and kind from a stream with a watermark."""
    e, root = table(spark, sf_dir, "events"), folder(spark, "windows")
    e.repartitionByRange(2, "ts").write.parquet(f"{root}/in")
    timed = ingest.new_documents(spark, f"{root}/in", e.schema, 1000).withColumn("ts", F.col("ts").cast("timestamp"))
    each = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out")  # noqa: E731  complete results replace each other
    ingest.windowed_counts(timed, "10 minutes", "1 day").writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    schema = "start timestamp, end timestamp, event_type string, n long, value double"
    out = spark.read.schema(schema).parquet(f"{root}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


def appended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory appended run by run; later runs have one column more, which earlier ones lack."""
    m, root = table(spark, sf_dir, "mpe_inventory").select("run_label", "mpe_id", "provisioning_state", "connection_status"), folder(spark, "runs")
    middle = "inv-20250601"
    sinks.append(m.where(F.col("run_label") < middle).drop("connection_status"), root)
    sinks.append(m.where(F.col("run_label") >= middle), root)
    return sinks.read_runs(spark, root, "mpe_id string, provisioning_state string, connection_status string, run_label string").groupBy("run_label").agg(F.count("*").alias("readings"), F.count("connection_status").alias("with_status"))


def upserted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings upserted into an empty star table in two overlapping loads."""
    root, wanted = folder(spark, "star"), [c.split()[0] for c in STAR["fact_scan_findings"][1].split(", ")]
    f = table(spark, sf_dir, "fact_scan_findings").select(*wanted)
    sinks.ensure(spark, STAR, root)
    for part in (f.where("severity IS NOT NULL"), f.where("kind IS NOT NULL")):
        sinks.write_facts(spark, root, STAR, "fact_scan_findings", part)
    return current(spark, f"{root}/fact_scan_findings").groupBy("severity").agg(F.count("*").alias("facts"), F.countDistinct("finding_id").alias("keys"))


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as CSV and as JSON lines, both read again."""
    root = folder(spark, "report")
    r = table(spark, sf_dir, "scan_results").where("severity IS NOT NULL").groupBy("severity", "category").agg(F.count("*").alias("n"))
    sinks.report(r, root)
    sinks.log(r, f"{root}/log")
    sinks.log(r, f"{root}/log")
    schema = "severity string, category string, n long"
    rows = [("csv", spark.read.schema(schema).option("header", "true").csv(f"{root}/csv")), ("json", spark.read.schema(schema).json(f"{root}/json")), ("log", spark.read.schema(schema).json(f"{root}/log"))]
    read = [d.withColumn("form", F.lit(k)) for k, d in rows]
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("form", "severity", "category").agg(F.sum("n").alias("n"))


def snapshot_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table overwritten twice: the second content replaces the first."""
    at, t = folder(spark, "snapshot"), table(spark, sf_dir, "item_inventory")
    sinks.overwrite(t.select("item_id").distinct(), at)
    sinks.overwrite(t.select("item_id", "item_type").distinct(), at)
    return spark.read.parquet(at).groupBy("item_type").agg(F.count("*").alias("items"))


def reread_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written is registered as a view and asked in SQL."""
    at, view = folder(spark, "view"), f"reread_{uuid.uuid4().hex}"
    sinks.overwrite(table(spark, sf_dir, "fabric_url_scanner").select("row_id", "direction").distinct(), at)
    files.reread(spark, at, view)
    return spark.sql(f"SELECT direction, count(*) AS n FROM {view} GROUP BY direction")


def prompts_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every chunk from a template, as the scorer gets it."""
    c = table(spark, sf_dir, "ai_chunks").select("notebook_id", "display_name", "chunk_index", "chunk_count", "chunk_text").distinct()
    named = c.withColumns({"chunk_number": F.col("chunk_index") + 1, "file_name": F.col("display_name")})
    return prompted(named, "File {file_name}, part {chunk_number} of {chunk_count}:\n{chunk_text}").select("notebook_id", "chunk_index", "prompt")


def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three sources that has any records: one fails, one is empty, the last has the regions' names page by page."""
    root = folder(spark, "sources")
    names = table(spark, sf_dir, "region").select("r_name")  # five rows
    sinks.write_texts(names.agg(F.to_json(F.struct(F.array_sort(F.collect_list("r_name")).alias("value"))).alias("t")).select(F.lit("0.json").alias("path"), "t"), "path", "t", root)
    sinks.write_texts(spark.createDataFrame([("none.json", '{"value": []}')], "path string, t string"), "path", "t", root)
    read = lambda name: lambda: [r for page in rest.pages(rest.stored, f"{root}/{name}", {}, sleep=lambda _: None) for r in page]
    return spark.createDataFrame([(r,) for r in rest.first_filled(read("missing.json"), read("none.json"), read("0.json"))], "name string")


def _measure(text: str) -> int:
    if text == "error":
        raise ValueError("cannot be measured")
    return len(text)


def calls_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per event from many tasks; a failed call is a row."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("spoke"), "event_type")
    ok, failed = outcomes(call_all(e, "spoke", "event_type", _measure, 5))
    told = lambda d: d.groupBy("spoke", "argument", "ok", "result", "error").agg(F.count("*").alias("n"))
    return told(ok).unionByName(told(failed))


def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five failures of every spoke, and partial counts of the spokes merged into one line."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5).cast("string").alias("spoke"), "event_id", (F.col("event_type") == "error").alias("failed"), "value")
    partial = e.groupBy("spoke").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.max("value").alias("longest"))
    whole = partial.agg(F.lit("(all)").alias("spoke"), F.sum("calls").alias("calls"), F.sum("failures").alias("failures"), F.max("longest").alias("longest")).where("calls IS NOT NULL")
    first = Window.partitionBy("spoke").orderBy("event_id")
    few = e.where("failed").withColumn("n", F.row_number().over(first)).where("n <= 5").groupBy("spoke").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), "|").alias("first_failures"))
    return partial.unionByName(whole).join(few, "spoke", "left")


def scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks scored by the stub scorer within the cap of three a document, with where the scores come from."""
    c = table(spark, sf_dir, "ai_chunks").select("notebook_id", "display_name", "chunk_index", "chunk_count", "chunk_text").distinct()
    out = stamped(score(c, length_scorer, folder(spark, "scores"), most_per_document=3), "auditor-1", "prompt-1", "run-1", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return out.select("notebook_id", "display_name", "chunk_index", "chunk_count", "external_resource_access_score", "exfiltration_risk_score", "rationale", "ai_error", "auditor_version", "prompt_version", "run_id")


def endpoint_with_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every waiting endpoint with the first item of its workspace."""
    m = table(spark, sf_dir, "mpe_inventory").where("lower(trim(connection_status)) = 'pending'").select("workspace_id", "mpe_id", "run_label").distinct()
    i = table(spark, sf_dir, "item_inventory").where("workspace_id IS NOT NULL").select("workspace_id", "item_id", "display_name")
    return with_first(m, i, "workspace_id", [F.asc_nulls_last("item_id"), F.asc_nulls_last("display_name")])


def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 failed endpoints, each with how many more there are."""
    m = table(spark, sf_dir, "mpe_inventory").where("lower(trim(provisioning_state)) = 'failed'").select("run_label", "workspace_id", "mpe_id", "mpe_name").distinct()
    total = m.count()
    return m.orderBy("run_label", F.asc_nulls_first("workspace_id"), F.asc_nulls_first("mpe_id"), F.asc_nulls_first("mpe_name")).limit(50).withColumn("more", F.lit(max(0, total - 50)).cast("long"))


def notebook_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspaces of the notebook sources, each once with one name."""
    return table(spark, sf_dir, "notebook_sources").where("workspace_id <> ''").groupBy(canonical_id(F.col("workspace_id")).alias("id")).agg(F.min("workspace_name").alias("name"))


def lakehouse_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attached lakehouses of all findings with their workspaces' names looked up by id where none is recorded."""
    f = table(spark, sf_dir, "scan_results").where("attached_lakehouse_id IS NOT NULL").select("attached_lakehouse_id", "attached_lakehouse_workspace_id", "attached_lakehouse_workspace_name").distinct()
    w = table(spark, sf_dir, "dim_workspace").select(F.col("workspace_id").alias("id"), F.col("workspace_name").alias("name"))
    return files.with_names(f, w, "attached_lakehouse_workspace_id", "attached_lakehouse_workspace_name")


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times kept as ISO texts while they are collected, and read as times at the end."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"))
    return e.select("event_id", "iso", F.unix_micros(F.to_timestamp("iso", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("micros"))


def plan_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a plan joined with their items by id."""
    i = table(spark, sf_dir, "item_inventory").groupBy("item_id").agg(F.min("display_name").alias("display_name"), F.min("item_type").alias("item_type"))
    s = table(spark, sf_dir, "scan_results").where("attached_lakehouse_id <> ''").select(F.col("attached_lakehouse_id").alias("item_id"), "notebook_id").distinct()
    return s.join(i, "item_id").groupBy("item_id", "display_name", "item_type").agg(F.count("*").alias("notebooks"))


_asked: Counter = Counter()


def rehearsal(method: str, url: str, headers: dict) -> rest.Answer:
    """A service in one function: by the last hex digit of an id it answers at once, is busy first, wants a new token, takes its time, fails or has nothing."""
    at, _, kind = url.partition("/operations/")
    if kind:
        return (200, {}, json.dumps({"definition": {"parts": [{"path": "late"}]}})) if kind.endswith("/result") else (200, {}, '{"status": "Succeeded"}' if at[-1] != "4" else '{"status": "Failed"}')
    _asked[url] += 1
    last, first = url[-1].lower(), _asked[url] % 2 == 1
    if last == "0" and first:
        return 429, {"Retry-After": "0"}, ""
    if last == "1" and headers.get("token") != "new":
        return 401, {}, ""
    if last in "34":
        return 202, {"Location": f"{url}/operations/1"}, ""
    if last == "5":
        return 404, {}, "no such item"
    return 200, {}, json.dumps({"definition": {"parts": []}})


def renewed() -> dict:
    return {"token": "new"}


def definitions_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of asking for the definition of every item, against a service that stands in for the real one."""
    i = table(spark, sf_dir, "item_inventory").select(canonical_id(F.col("item_id")).alias("item_id")).where("item_id IS NOT NULL").distinct()
    asked = fetched_definitions(i.withColumn("url", F.concat(F.lit("rehearsal://items/"), "item_id")), "url", "tessera.plans.pipelines:rehearsal", {"token": "old"}, "tessera.plans.pipelines:renewed", wait=False)
    return asked.select("item_id", "http_status", "attempts", "token_refreshes", F.col("body").isNotNull().alias("has_body"), F.substring("fetch_error", 1, 16).alias("error"))


def scan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspaces in batches of at most 100: how many ids all batches hold, and whether any is too large."""
    b = scanned_in_batches(table(spark, sf_dir, "dim_workspace").select(canonical_id(F.col("workspace_id")).alias("id")), "id")
    return b.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("ids"), F.coalesce(F.max(F.size("ids")) <= 100, F.lit(True)).alias("within_size"))


def recorded_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources' recorded hashes agree with their texts."""
    n = table(spark, sf_dir, "notebook_sources").select("source_id", "content_hash", "source_text").distinct()
    same = F.when(F.col("content_hash").isNull(), "none").when(F.col("content_hash") == content_hash16(F.col("source_text")), "same").otherwise("other")
    return n.groupBy(same.alias("agreement")).agg(F.count("*").alias("sources"))


QUERIES = {
    f.__name__: f
    for f in (
        files_scanned, rest_pages, streamed_batches, streamed_windows, appended_runs, upserted_facts, reported, snapshot_taken, reread_view, prompts_made, first_source, calls_made, first_failures, scored_chunks, endpoint_with_item, previewed,
        notebook_workspaces, lakehouse_workspaces, iso_times, plan_of_items, definitions_fetched, scan_batches, recorded_hashes,
    )
}


def _id(c: str) -> str:
    h = f"lower(regexp_replace({c}, '[^0-9A-Fa-f]', '', 'g'))"
    return f"CASE WHEN length({h}) = 32 THEN regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') WHEN trim({c}) <> '' THEN lower(trim({c})) END"


_GUID = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"
_DATE = "replace(source_dated_partition, '-', '')"
_FAILED = "FROM (SELECT DISTINCT run_label, workspace_id, mpe_id, mpe_name FROM mpe_inventory WHERE lower(trim(provisioning_state)) = 'failed')"
ORACLE = {
    "files_scanned": f"""SELECT DISTINCT source_id, CASE WHEN {_DATE} IS NOT NULL AND regexp_matches({_id("workspace_id")}, {_GUID}) THEN {_id("workspace_id")} ELSE 'none' END AS workspace_id,
        CASE WHEN regexp_matches({_id("workspace_id")}, {_GUID}) THEN {_DATE} END AS dated, strlen(source_text) AS length, left(sha256(source_text), 16) AS content_hash FROM notebook_sources WHERE source_text IS NOT NULL AND source_id IS NOT NULL""",
    "rest_pages": "SELECT CAST((row_number() OVER (ORDER BY workspace_id NULLS FIRST, workspace_name NULLS FIRST, capacity_id NULLS FIRST) - 1) // 50 AS INTEGER) AS page, workspace_id, workspace_name, capacity_id FROM (SELECT DISTINCT workspace_id, workspace_name, capacity_id FROM dim_workspace)",
    "streamed_batches": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1",
    "streamed_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "appended_runs": "SELECT run_label, count(*) AS readings, count(CASE WHEN run_label >= 'inv-20250601' THEN connection_status END) AS with_status FROM mpe_inventory WHERE run_label IS NOT NULL GROUP BY 1",
    "upserted_facts": "SELECT severity, count(*) AS facts, count(DISTINCT finding_id) AS keys FROM (SELECT finding_id, max(severity) AS severity FROM fact_scan_findings WHERE finding_id IS NOT NULL AND (severity IS NOT NULL OR kind IS NOT NULL) GROUP BY 1) GROUP BY 1",
    "reported": "SELECT form, severity, category, CASE WHEN form = 'log' THEN 2 ELSE 1 END * count(*) AS n FROM scan_results, (VALUES ('csv'), ('json'), ('log')) v(form) WHERE severity IS NOT NULL GROUP BY 1, 2, 3",
    "snapshot_taken": "SELECT item_type, count(*) AS items FROM (SELECT DISTINCT item_id, item_type FROM item_inventory) GROUP BY 1",
    "reread_view": "SELECT direction, count(*) AS n FROM (SELECT DISTINCT row_id, direction FROM fabric_url_scanner) GROUP BY 1",
    "prompts_made": "SELECT DISTINCT notebook_id, chunk_index, 'File ' || coalesce(display_name, '') || ', part ' || coalesce(CAST(chunk_index + 1 AS VARCHAR), '') || ' of ' || coalesce(CAST(chunk_count AS VARCHAR), '') || ':' || chr(10) || coalesce(chunk_text, '') AS prompt FROM ai_chunks",
    "first_source": "SELECT r_name AS name FROM region WHERE r_name IS NOT NULL",
    "calls_made": "SELECT CAST(event_id % 5 AS VARCHAR) AS spoke, event_type AS argument, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN CAST(length(event_type) AS VARCHAR) END AS result, CASE WHEN event_type = 'error' THEN 'ValueError: cannot be measured' END AS error, count(*) AS n FROM events GROUP BY 1, 2, 3, 4, 5",
    "first_failures": """WITH e AS (SELECT CAST(event_id % 5 AS VARCHAR) AS spoke, event_id, event_type = 'error' AS failed, value FROM events),
        p AS (SELECT spoke, count(*) AS calls, count(*) FILTER (failed) AS failures, max(value) AS longest FROM e GROUP BY 1 UNION ALL SELECT '(all)', count(*), count(*) FILTER (failed), max(value) FROM e HAVING count(*) > 0),
        f AS (SELECT spoke, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id) AS first_failures FROM (SELECT spoke, event_id FROM e WHERE failed QUALIFY row_number() OVER (PARTITION BY spoke ORDER BY event_id) <= 5) GROUP BY 1)
        SELECT p.*, f.first_failures FROM p LEFT JOIN f USING (spoke)""",
    "scored_chunks": """SELECT notebook_id, display_name, chunk_index, chunk_count, CAST(least(length(chunk_text), 100) AS INTEGER) AS external_resource_access_score, CAST(least((length(chunk_text) - length(replace(chunk_text, '://', ''))) // 3, 100) AS INTEGER) AS exfiltration_risk_score,
        'by length' AS rationale, CAST(NULL AS VARCHAR) AS ai_error, 'auditor-1' AS auditor_version, 'prompt-1' AS prompt_version, 'run-1' AS run_id FROM (SELECT DISTINCT notebook_id, display_name, chunk_index, chunk_count, chunk_text FROM ai_chunks WHERE chunk_index < 3)""",
    "endpoint_with_item": """WITH i AS (SELECT workspace_id, item_id, display_name FROM item_inventory WHERE workspace_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY item_id NULLS LAST, display_name NULLS LAST) = 1)
        SELECT DISTINCT m.workspace_id, m.mpe_id, m.run_label, i.item_id, i.display_name FROM mpe_inventory m LEFT JOIN i USING (workspace_id) WHERE lower(trim(m.connection_status)) = 'pending'""",
    "previewed": f"SELECT *, (SELECT greatest(0, count(*) - 50) {_FAILED}) AS more {_FAILED} ORDER BY run_label, workspace_id NULLS FIRST, mpe_id NULLS FIRST, mpe_name NULLS FIRST LIMIT 50",
    "notebook_workspaces": f"SELECT {_id('workspace_id')} AS id, min(workspace_name) AS name FROM notebook_sources WHERE workspace_id <> '' GROUP BY 1",
    "lakehouse_workspaces": """WITH w AS (SELECT lower(workspace_id) AS id, min(workspace_name) AS name FROM dim_workspace WHERE workspace_id <> '' AND workspace_name <> '' GROUP BY 1)
        SELECT attached_lakehouse_id, attached_lakehouse_workspace_id, coalesce(nullif(attached_lakehouse_workspace_name, ''), w.name) AS attached_lakehouse_workspace_name
        FROM (SELECT DISTINCT attached_lakehouse_id, attached_lakehouse_workspace_id, attached_lakehouse_workspace_name FROM scan_results WHERE attached_lakehouse_id IS NOT NULL) f LEFT JOIN w ON lower(attached_lakehouse_workspace_id) = w.id""",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, epoch_us(ts) AS micros FROM events",
    "plan_of_items": "WITH i AS (SELECT item_id, min(display_name) AS display_name, min(item_type) AS item_type FROM item_inventory GROUP BY 1), s AS (SELECT DISTINCT attached_lakehouse_id AS item_id, notebook_id FROM scan_results WHERE attached_lakehouse_id <> '') SELECT item_id, display_name, item_type, count(*) AS notebooks FROM s JOIN i USING (item_id) GROUP BY 1, 2, 3",
    "definitions_fetched": f"""SELECT DISTINCT item_id, CAST(CASE right(item_id, 1) WHEN '5' THEN 404 ELSE 200 END AS INTEGER) AS http_status, CAST(CASE WHEN right(item_id, 1) IN ('0', '1') THEN 2 ELSE 1 END AS INTEGER) AS attempts,
        CAST(CASE right(item_id, 1) WHEN '1' THEN 1 ELSE 0 END AS INTEGER) AS token_refreshes, right(item_id, 1) NOT IN ('4', '5') AS has_body, CASE right(item_id, 1) WHEN '4' THEN 'operation failed' WHEN '5' THEN 'no such item' END AS error
        FROM (SELECT {_id("item_id")} AS item_id FROM item_inventory) WHERE item_id IS NOT NULL""",
    "scan_batches": f"SELECT count(DISTINCT {_id('workspace_id')}) AS ids, true AS within_size FROM dim_workspace",
    "recorded_hashes": "SELECT CASE WHEN content_hash IS NULL THEN 'none' WHEN content_hash = CASE WHEN coalesce(source_text, '') = '' THEN '' ELSE left(sha256(source_text), 16) END THEN 'same' ELSE 'other' END AS agreement, count(*) AS sources FROM (SELECT DISTINCT source_id, content_hash, source_text FROM notebook_sources) GROUP BY 1",
}
