"""Severities as an order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severities from the lowest, and the seed rows of their dimension (0 is the gravest).
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_ROWS = (("critical", 0, "#d13438"), ("high", 1, "#ff8c00"), ("medium", 2, "#ffb900"), ("low", 3, "#107c10"))


def ordinal(severity: Column) -> Column:
    """0 for critical to 3 for low, 4 for NULL and anything else."""
    c = F.when(severity == "critical", 0)
    for name, n, _ in SEVERITY_ROWS[1:]:
        c = c.when(severity == name, n)
    return c.otherwise(4)


def meets(severity: Column, least: str) -> Column:
    """Whether a severity reaches ``least``; an unknown severity passes, an unknown ``least`` lets all pass."""
    least = least.lower()
    floor = SEVERITIES.index(least) if least in SEVERITIES else 0
    return F.when(severity.isin(*SEVERITIES[:floor]), False).otherwise(True) if floor else F.lit(True)
