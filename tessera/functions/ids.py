"""Identifiers and states as comparable values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex32(c: Column) -> Column:
    """The 32 hex digits of a GUID in any spelling, lower-case; NULL for anything else."""
    h = F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(h) == 32, h)


#: The spelling that most ids have already; it is told by one cheap match.
CANONICAL = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def canonical_id(c: Column) -> Column:
    """A GUID in lower case with hyphens; another id trimmed and lower-cased; NULL for NULL and blank."""
    h = hex32(c)
    guid = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    other = F.lower(F.trim(c))
    return F.when(c.rlike(CANONICAL), c).otherwise(F.coalesce(guid, F.when(other != "", other)))


def reference_id(c: Column) -> Column:
    """``canonical_id`` of a reference: the all-zero GUID is no reference and gives NULL."""
    nil = ~c.rlike("[^0{}() -]")  # nothing but zeros and what is written around them
    return F.when(~nil, canonical_id(c))


def state(c: Column) -> Column:
    """A state for comparison: trimmed, lower-cased, NULL as blank."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))
