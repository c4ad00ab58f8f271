"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _characters(s: Column) -> Column:
    return F.length(s)


def trim_snippet(text: Column, most: int) -> Column:
    """The text without outer blanks, cut to ``most`` characters with an ellipsis as the last; NULL as ''."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(_characters(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def redact(text: Column, keep: int = 4) -> Column:
    """The middle masked with one star per character, ``keep`` characters left at each end; short texts become ``***``."""
    t = F.trim(text)
    n = _characters(t)
    masked = F.concat(F.substring(t, 1, keep), F.repeat(F.lit("*"), (n - 2 * keep).cast("int")), F.right(t, F.lit(keep)))
    return F.when(text == "", text).when(n <= 2 * keep + 3, F.lit("***")).otherwise(masked)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    total = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(text.isNull(), None).when(text == "", 0.0).otherwise(total)


def safe_segment(text: Column, most: int = 80) -> Column:
    """A file-name segment: other characters than letters, digits, dot, underscore and hyphen become underscores, outer ``._-`` go; ``unnamed`` where nothing is left."""
    s = F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")
    s = F.regexp_replace(s, "^[._-]+|[._-]+$", "")
    return F.substring(F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed")), 1, most)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def content_hash16(text: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256; '' for NULL and empty texts."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.substring(F.sha2(text, 256), 1, 16))


def line_number(text: Column, offset: Column) -> Column:
    """The line (from 1, ending at \\n) of a 0-based character offset."""
    before = F.substr(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def resource_provider(resource_id: Column) -> Column:
    """Provider and type of a resource id: the two segments after ``/providers/``; NULL without them."""
    tail = F.regexp_extract(resource_id, "/providers/([^/]*/[^/]*)", 1)
    return F.nullif(tail, F.lit(""))


# The API version of each resource provider's private endpoint connections, and the one for others.
API_VERSIONS = {
    "Microsoft.Storage/storageAccounts": "2023-05-01",
    "Microsoft.Sql/servers": "2023-08-01-preview",
    "Microsoft.KeyVault/vaults": "2023-07-01",
    "Microsoft.DocumentDB/databaseAccounts": "2023-04-15",
    "Microsoft.EventHub/namespaces": "2024-01-01",
    "Microsoft.ServiceBus/namespaces": "2022-10-01-preview",
    "Microsoft.Synapse/workspaces": "2021-06-01",
    "Microsoft.Search/searchServices": "2023-11-01",
    "Microsoft.CognitiveServices/accounts": "2023-05-01",
    "Microsoft.AppConfiguration/configurationStores": "2023-03-01",
    "Microsoft.Web/sites": "2023-12-01",
    "Microsoft.ContainerRegistry/registries": "2023-11-01-preview",
    "Microsoft.DataFactory/factories": "2018-06-01",
    "Microsoft.Purview/accounts": "2021-12-01",
}
OTHER_API_VERSION = "2023-09-01"


def api_version(provider: Column) -> Column:
    versions = F.create_map(*[F.lit(x) for pair in API_VERSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(versions, provider), F.lit(OTHER_API_VERSION))


def run_label(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd_HH-mm-ss")


def logical_key(workspace_id: Column, name: Column) -> Column:
    """A resource key: the first 8 characters of the workspace and the name, hyphens and blanks as underscores."""
    return F.translate(F.concat_ws("_", F.substring(workspace_id, 1, 8), name), "- ", "__")


# Words that tell a sink from a source.
SINK_WORDS = ("sink", "destination", "output", "write", "copy into", "target")
SOURCE_WORDS = ("source", "input", "read", "origin", "from")


def flow_direction(context: Column) -> Column:
    """sink, source, both or unknown, by the words of a context."""
    low = F.lower(F.coalesce(context, F.lit("")))
    sink, source = low.rlike("|".join(SINK_WORDS)), low.rlike("|".join(SOURCE_WORDS))
    return F.when(sink & source, "both").when(sink, "sink").when(source, "source").otherwise("unknown")
