"""Severity vocabulary as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored severities from most to least severe.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]
# Tool levels that are stored under another name.
TOOL_LEVELS = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}


def map_severity(raw: Column) -> Column:
    """Tool level -> stored severity; anything unmapped (NULL too) is UNKNOWN.

    A lookup: ``raw`` is worked out once per row, where branches would repeat what it is made of.
    """
    stored = {**{level: level for level in SEVERITIES[:4]}, **TOOL_LEVELS}
    names = F.create_map(*[F.lit(x) for pair in stored.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.upper(raw)), F.lit("UNKNOWN"))


def severity_ordinal(severity: Column) -> Column:
    """Position in SEVERITIES; values outside the vocabulary come last."""
    position = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(position > 0, position - 1).otherwise(len(SEVERITIES)).cast("int")
