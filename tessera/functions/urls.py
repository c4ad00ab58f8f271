"""Addresses: destinations, benign ones, directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes of addresses.
SCHEMES = (
    "http https ftp ftps sftp abfs abfss wasb wasbs adl s3 s3a s3n gs hdfs viewfs dbfs jdbc odbc mongodb mongodb+srv postgresql postgres mysql mssql "
    "redis rediss amqp amqps kafka kinesis eventhubs mqtt mqtts ssh scp smb nfs tcp udp"
).split()
# What ends an address, what is cut from its end, and addresses that don't count.
STOP = r"\s\"'`<>)\]},;"
TRAILING = ".,;:!?)]}>\"'`"
BENIGN = (
    r"(?i)https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)(:|/|$)",
    r"(?i)https?://json\.schemastore\.org/",
    r"(?i)https?://schemas?\.(microsoft|xmlsoap|w3)\.",
    r"(?i)https?://(pypi|pip|conda|anaconda)\.(org|io)/",
    r"(?i)https?://(docs|learn|aka)\.(microsoft|python|spark)\.",
    r"(?i)https?://spark\.apache\.org/",
)
# Addresses that name a workspace, by id or by name.
_BY_CONTAINER = r"(?i)abfss?://([^@/\s]+)@onelake\.dfs\.fabric\.microsoft\.com"
_BY_PATH = r"(?i)https?://[^/\s]*\.fabric\.microsoft\.com/(?:[^?\s]*?/)?(?:v1/)?workspaces/([0-9a-f-]{8,})"
_BY_GROUP = r"(?i)https?://(?:app|api)\.powerbi\.com/(?:[^/\s]*/)*?groups/([0-9a-f-]{8,})"
DESTINATIONS = (_BY_CONTAINER, _BY_PATH, _BY_GROUP)
# An address of each of these ways, # standing for the workspace, and one that names none.
EXAMPLES = {
    "container": "abfss://#@onelake.dfs.fabric.microsoft.com/x/Files/y",
    "path": "https://api.fabric.microsoft.com/v1/workspaces/#/items",
    "group": "https://app.powerbi.com/groups/#/reports/r",
    "none": "https://#.example/groups",
}
GUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"


def pattern(strict: bool = False) -> str:
    """The pattern of an address; ``strict`` asks for a word boundary before the scheme."""
    names = "|".join(s.replace("+", r"\+") for s in sorted(SCHEMES, key=lambda s: (-len(s), s)))
    edge = r"\b" if strict else ""
    return rf"(?i){edge}(?:{names})s?://[^{STOP}]+|{edge}(?:{names})s?:[^{STOP}]+|\bwww\.[^{STOP}]+\.[^{STOP}]+"


def destination(url: Column) -> Column:
    """The workspace id or name that an address names, or NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in DESTINATIONS])


def is_benign(url: Column) -> Column:
    hit = F.lit(False)
    for p in BENIGN:
        hit = hit | url.rlike(p)
    return hit


def resolve(raw: Column, by_id_name: Column, by_name_id: Column, source_id: Column, source_name: Column) -> tuple[Column, Column, Column]:
    """Destination id, name and whether it lies elsewhere (NULL where that can't be told).

    ``by_id_name`` and ``by_name_id`` are what dimension joins on the id and on the lower-cased name found.
    """
    guid = raw.rlike(GUID)
    dest_id = F.when(guid, F.lower(raw)).otherwise(by_name_id)
    dest_name = F.when(guid, by_id_name).otherwise(raw)
    known = F.coalesce(dest_id, F.lit("")) != ""
    by_ids = known & source_id.rlike(GUID)
    by_names = (F.coalesce(dest_name, F.lit("")) != "") & (F.coalesce(source_name, F.lit("")) != "")
    cross = F.when(by_ids, dest_id != F.lower(source_id)).when(by_names, F.lower(dest_name) != F.lower(source_name))
    return F.nullif(dest_id, F.lit("")), F.nullif(dest_name, F.lit("")), cross
