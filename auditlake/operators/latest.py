"""Latest scan per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPES = ("any", "non_quality", "quality")


def _in_scope(scope: str) -> Column | None:
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    # A NULL scan type is in neither restricted scope (three-valued logic).
    return {
        "any": None,
        "non_quality": F.col("scan_type") != "quality",
        "quality": F.col("scan_type") == "quality",
    }[scope]


def latest_scans(scans: DataFrame, scope: str = "non_quality") -> DataFrame:
    """(repository_id, scan_id) of each repository's highest scan id in the scope.

    max() combines map-side, so a repository with most of the scans still sends
    one row per task; callers join the result, they never sort scans.
    """
    condition = _in_scope(scope)
    if condition is not None:
        scans = scans.filter(condition)
    return scans.groupBy("repository_id").agg(F.max("id").alias("scan_id"))


def last_scan_by_time(scans: DataFrame, scan_type: str) -> DataFrame:
    """Per repository the newest scan of one type by (created_at, id)."""
    newest = F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("newest")
    return (
        scans.filter(F.col("scan_type") == scan_type)
        .groupBy("repository_id")
        .agg(newest)
        .select("repository_id", F.col("newest.id").alias("scan_id"), F.col("newest.created_at").alias("created_at"))
    )
