"""Nested columns: errors as structs, clamps, endpoint arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENDPOINTS = "array<struct<endpoint:string,type:string,deterministic:boolean>>"
#: The answer that a scored chunk holds as JSON.
ANSWER = f"external_resource_access_score int, exfiltration_risk_score int, sources {ENDPOINTS}, destinations {ENDPOINTS}, rationale string"


def any_leaf(c: Column, kind: T.DataType) -> Column:
    """Whether any leaf of a (nested) struct is known."""
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a | b, [any_leaf(c[f.name], f.dataType) for f in kind.fields], F.lit(False))
    return c.isNotNull()


def error_text(df: DataFrame, name: str) -> Column:
    """An error column as a string: a struct whose leaves are all NULL is no error, another one becomes JSON."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StructType):
        return F.when(any_leaf(F.col(name), kind), F.to_json(name))
    return F.col(name).cast("string")


def clamp(c: Column, low: int, high: int) -> Column:
    """A number within its limits; NULL stays NULL (least and greatest would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(ENDPOINTS))
