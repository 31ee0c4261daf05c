"""Deletes, upserts and merges as new snapshots; inputs are never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import strip

# The two kinds of chat thread and the key each one is found by.
THREAD_KEYS = {"finding": "finding_id", "quality": "quality_interpretation_id"}


def delete_scans(store: dict[str, DataFrame], scan_ids: DataFrame) -> dict[str, DataFrame]:
    """The store without some scans and everything below them.

    Keys travel down the foreign keys as DataFrames: first the doomed findings'
    ids, found by a semi join, then what hangs on those.
    """
    keys = scan_ids.select("scan_id").distinct()
    doomed = store["findings"].join(keys, "scan_id", "left_semi").select(F.col("id").alias("finding_id"))
    remaining = dict(store)
    if "scan" in store:
        remaining["scan"] = store["scan"].join(keys.withColumnRenamed("scan_id", "id"), "id", "left_anti")
    for name in ("findings", "quality_metric"):
        if name in store:
            remaining[name] = store[name].join(keys, "scan_id", "left_anti")
    for name in ("evidence", "patch"):
        if name in store:
            remaining[name] = store[name].join(doomed, "finding_id", "left_anti")
    return remaining


def delete_threads(messages: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    """Messages without the threads of one kind; an unknown kind is an error."""
    if kind not in THREAD_KEYS:
        raise ValueError(f"unknown thread kind {kind!r}")
    key = THREAD_KEYS[kind]
    return messages.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """At most one row per key: the newest new row, else the old one."""
    row = F.max_by(F.struct(*new.columns), F.struct(*order)).alias("row")
    newest = new.groupBy(keys).agg(row).select("row.*")
    return old.join(newest.select(keys), keys, "left_anti").unionByName(newest, allowMissingColumns=True)


def merge_scores(findings: DataFrame, answers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rechecked confidence replaces the stored one; an answer that is no number scores 0.

    Of several answers about a finding the newest by ``order`` counts.
    """
    score = F.coalesce(strip(F.col("answer")).try_cast("double"), F.lit(0.0))
    scores = answers.groupBy(key).agg(F.max_by(score, F.struct(*order, "answer")).alias("_score"))
    return (
        findings.join(scores, key, "left")
        .withColumn("confidence_score", F.coalesce("_score", "confidence_score"))
        .drop("_score")
    )
