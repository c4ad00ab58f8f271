"""Scans of documents made from the items' ids, so that every finding is known beforehand and SQL can say it.

Each query builds one document, definition or address for every item and compares what the operators tell with what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.functions.ids import canonical_id
from tessera.functions.jsons import definition_details
from tessera.functions.text import API_VERSIONS, OTHER_API_VERSION, api_version, resource_provider
from tessera.operators.chunking import BOUNDARY, chunk_documents
from tessera.operators.first_generation import scan_texts
from tessera.operators.scan import scan_documents
from tessera.plans.findings import cross_workspace_flows
from tessera.plans.pipelines import _id
from tessera.session import table

#: A literal of high entropy, in pieces.
_ODD = "aB3dE5fG7hI9jK1l" + "M3nO5pQ7rS9tU1vW3xY5zA7bC9d"
_CODE = f"""import requests, os
from paramiko import SSHClient
x = eval("#")
requests.get("https://#.example/a"); requests.get("https://#.EXAMPLE/A/")
requests.post("https://#.example/b).")
frame.write.format("x"); frame.write.format("y")
y = "{_ODD}"
see = "http://localhost:8080/z https://pypi.org/project"
"""
_NOTE = "see https://#.example/m, or www.#.example."


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    guid = "^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
    return table(spark, sf_dir, "item_inventory").select(canonical_id(F.col("item_id")).alias("id")).where(F.col("id").rlike(guid)).distinct()


def _filled(text: str) -> Column:
    return F.replace(F.lit(text), F.lit("#"), F.col("id"))


def _notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notebook for every item: code with an output, a note, and the item as its attached lakehouse."""
    cell = "struct<cell_type:string,source:string,outputs:array<struct<text:string>>>"
    out = F.array(F.struct(F.concat(F.lit("done: https://"), F.col("id"), F.lit(".example/o")).alias("text")))
    code = F.struct(F.lit("code").alias("cell_type"), _filled(_CODE).alias("source"), out.alias("outputs")).cast(cell)
    note = F.struct(F.lit("markdown").alias("cell_type"), _filled(_NOTE).alias("source"), F.lit(None).alias("outputs")).cast(cell)
    lake = F.struct(F.struct(F.struct(F.col("id").alias("default_lakehouse"), F.lit("L").alias("default_lakehouse_name")).alias("lakehouse")).alias("dependencies"))
    return _ids(spark, sf_dir).withColumn("content", F.to_json(F.struct(F.array(code, note).alias("cells"), lake.alias("metadata")))).withColumn("path", F.concat("id", F.lit(".ipynb")))


def planted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, dynamic calls, odd literals, addresses and write calls with their places; rules are counted by rule_totals."""
    f = scan_documents(_notebooks(spark, sf_dir), "id", "path", "content").where("finding_type <> 'pattern' OR finding_type IS NULL")
    return f.select("id", "attached_lakehouse_id", "attached_lakehouse_name", "source_kind", "cell_index", "line_number", "finding_type", "category", "severity", "url", "direction", "error")


def planted_first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first generation's findings: addresses by the closest call, masked secrets, write calls with their line."""
    code = 'requests.post("https://#.example/a"); requests.get("https://#.example/A")\nPassword=#;\nPassword=#;\nframe.write.mode("x")\n'
    made = _ids(spark, sf_dir).withColumn("content", _filled(code)).withColumn("path", F.concat("id", F.lit(".py")))
    return scan_texts(made, "id", "path", "content").select("id", "source_kind", "url", "direction", "secret_type", "match_snippet", "error")


def planted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two short cells in one chunk, a long one cut at a line end, a note left out."""
    cell = lambda kind, source: F.struct(F.lit(kind).alias("cell_type"), source.alias("source"))
    long = F.concat(F.repeat(F.lit("x"), 80), F.lit("\n"), F.repeat(F.lit("y"), 80))
    made = _ids(spark, sf_dir).withColumn("content", F.to_json(F.struct(F.array(cell("code", F.col("id")), cell("markdown", F.lit("note")), cell("code", F.col("id")), cell("code", long)).alias("cells")))).withColumn("path", F.concat("id", F.lit(".ipynb")))
    return chunk_documents(made, "id", "path", "content", 100 + len(BOUNDARY)).select("id", "content_length", "content_hash", "chunk_index", "chunk_count", "chunk_text")


def planted_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections, copies, addresses and connection strings of definitions."""
    text = '{"activities":[{"type":"Copy","connectionReference":{"type":"Sql","connectionId":"#"},"typeProperties":{"server":"s","catalog":"c"},"sink":{"type":"Blob","url":"https://#.example/u"}}],"note":"Server=tcp:#;"}'
    d = definition_details(_ids(spark, sf_dir).withColumn("t", _filled(text)), "id", "t")
    return d.select("id", "json_path", "detail_type", "value", "direction")


def planted_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspace that every way of naming one in an address tells, and none where none is named."""
    ways = {name: _filled(address) for name, address in urls.EXAMPLES.items()}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("way"), a.alias("url")) for n, a in ways.items()]))
    return _ids(spark, sf_dir).select("id", each.alias("e")).select("id", "e.way", urls.destination(F.col("e.url")).alias("destination"))


def planted_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API versions of resources of every known provider, and of another."""
    names = [*API_VERSIONS, "Vendor.Other/things"]
    i = _ids(spark, sf_dir).withColumn("p", F.explode(F.array(*map(F.lit, names))))
    found = i.select(resource_provider(F.concat(F.lit("/subscriptions/s/resourceGroups/r/providers/"), "p", F.lit("/"), "id")).alias("provider"))
    return found.withColumn("version", api_version(F.col("provider"))).groupBy("provider", "version").agg(F.count("*").alias("resources"))


def lakehouse_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from notebooks to the workspaces of their lakehouses, as the flows of addresses are rolled up."""
    f = table(spark, sf_dir, "scan_results").withColumn("dest_workspace_name", F.col("attached_lakehouse_workspace_name"))
    return cross_workspace_flows(f.withColumn("cross_workspace", F.lower("attached_lakehouse_workspace_id") != F.lower("workspace_id")))


QUERIES = {f.__name__: f for f in (planted_findings, planted_first_findings, planted_chunks, planted_structures, planted_destinations, planted_providers, lakehouse_flows)}

_I = f"WITH i AS (SELECT DISTINCT id FROM (SELECT {_id('item_id')} AS id FROM item_inventory) WHERE regexp_matches(id, '^[0-9a-f]{{8}}-([0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}$'))"


def _values(rows: list[tuple], names: str) -> str:
    """Rows in which # stands for the id."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "replace('" + v.replace("'", "''") + "', '#', id)"
    return " UNION ALL ".join(f"SELECT id, {', '.join(f'{show(v)} AS {n}' for v, n in zip(r, names.split()))} FROM i" for r in rows)


_FOUND = [
    ("code", 0, 1, "import", "http_exfiltration", "high", None, None),
    ("code", 0, 2, "import", "filesystem_exfiltration", "high", None, None),
    ("code", 0, 3, "dynamic_exec", "dynamic_code_execution", "critical", None, None),
    ("code", 0, 7, "entropy", "encoding_obfuscation", "high", None, None),
    ("code", 0, 4, "url", "external_url_reference", "medium", "https://#.example/a", "read"),
    ("code", 0, 5, "url", "external_url_reference", "medium", "https://#.example/b", "read_write"),
    ("code", 0, 5, "potential_write", "potential_write", "medium", None, "potential_write"),
    ("code", 0, 6, "potential_write", "potential_write", "medium", None, "potential_write"),
    ("output", 0, 1, "url", "external_url_reference", "low", "https://#.example/o", "reference"),
    ("markdown", 1, 1, "url", "external_url_reference", "low", "https://#.example/m", "reference"),
    ("markdown", 1, 1, "url", "external_url_reference", "low", "www.#.example", "reference"),
]
_SECRET = "left(s, 4) || repeat('*', CAST(length(s) - 8 AS INTEGER)) || right(s, 4)"
ORACLE = {
    "planted_findings": _I + f""", f AS ({_values(_FOUND, 'source_kind cell_index line_number finding_type category severity url direction')}
        UNION ALL SELECT id, 'code', 0, line, 'entropy', 'encoding_obfuscation', 'high', NULL, NULL FROM (SELECT id, unnest([4, 4, 5]) AS line, unnest(['https://' || id || '.example/a', 'https://' || id || '.EXAMPLE/A/', 'https://' || id || '.example/b).']) AS literal FROM i)
        WHERE list_aggregate(string_split(literal, ''), 'entropy') > 4.5) SELECT id, id AS attached_lakehouse_id, 'L' AS attached_lakehouse_name, source_kind, CAST(cell_index AS INTEGER) AS cell_index, CAST(line_number AS INTEGER) AS line_number, finding_type, category, severity, url, direction, CAST(NULL AS VARCHAR) AS error FROM f""",
    "planted_first_findings": _I + ", f AS (" + _values([("https://#.example/a", "write", None, None), ("https://#.example/A", "read", None, None), (None, "potential_write", "requests.post(", 'requests.post("https://#.example/a"); requests.get("https://#.example/A")'), (None, "potential_write", ".write.mode(", 'frame.write.mode("x")')], "url direction secret_type match_snippet")
    + f" UNION ALL SELECT id, NULL, 'unknown', 'SQL Password', {_SECRET} FROM (SELECT id, 'Password=' || id AS s FROM i)) SELECT id, 'code' AS source_kind, url, direction, secret_type, CASE WHEN length(match_snippet) > 200 THEN left(match_snippet, 200) || '...' ELSE match_snippet END AS match_snippet, CAST(NULL AS VARCHAR) AS error FROM f",
    "planted_chunks": _I + f""", w AS (SELECT id, '{BOUNDARY}' AS b, repeat('x', 80) AS x, repeat('y', 80) AS y FROM i), t AS (SELECT *, id || b || id || b || x || chr(10) || y AS whole FROM w),
        c AS (SELECT *, unnest([0, 1, 2]) AS n FROM t) SELECT id, length(whole) AS content_length, left(sha256(whole), 16) AS content_hash, CAST(n AS INTEGER) AS chunk_index, CAST(3 AS INTEGER) AS chunk_count, CASE n WHEN 0 THEN id || b || id WHEN 1 THEN x ELSE y END AS chunk_text FROM c""",
    "planted_structures": _I + ", f AS (" + _values(
        [
            ("$.activities[0]", "connection_reference", '{"connection_type": "Sql", "connection_id": "#", "server": "s", "database": "c", "url": ""}', "unknown"),
            ("$.activities[0]", "pipeline_sink", '{"type": "Blob", "server": "", "database": "", "url": "https://#.example/u", "connection_id": "", "connection_type": ""}', "sink"),
            (None, "url", "https://#.example/u", "sink"),
            (None, "connection_string", "Server=tcp:#", "sink"),
        ],
        "json_path detail_type value direction",
    )
    + ") SELECT * FROM f",
    "planted_destinations": _I + f", f AS ({_values([(way, None if way == 'none' else '#') for way in urls.EXAMPLES], 'way destination')}) SELECT * FROM f",
    "planted_providers": _I + ", p(provider, version) AS (VALUES " + ", ".join(f"('{n}', '{v}')" for n, v in [*API_VERSIONS.items(), ("Vendor.Other/things", OTHER_API_VERSION)]) + ") SELECT provider, version, count(*) AS resources FROM i, p GROUP BY 1, 2",
    "lakehouse_flows": "SELECT workspace_name AS src_ws, attached_lakehouse_workspace_name AS dest_ws, direction, count(*) AS n FROM scan_results WHERE lower(attached_lakehouse_workspace_id) <> lower(workspace_id) GROUP BY 1, 2, 3 ORDER BY n DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 100",
}
