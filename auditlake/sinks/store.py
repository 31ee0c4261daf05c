"""Writing the findings store and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.filters import might_hold
from auditlake.schemas import EXPORT_COLUMNS, STORE
from auditlake.session import shared_path
from auditlake.sources.store import read_table


SCAN_BITS = 1 << 26  # 8 MB: one scan a repository is exported, of millions of repositories


def new_store(spark: SparkSession) -> str:
    """An empty store folder below the shared folder of the session."""
    return shared_path(spark, "store")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Exactly the table's columns and types, in order; columns that are missing are NULL."""
    return df.select(
        [
            (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in STORE[name].fields
        ]
    )


def append_batch(df: DataFrame, root: str, name: str, batch_id: str) -> str:
    """Write one batch to its own folder of a table.

    A rerun of the batch replaces exactly that folder, so appends are idempotent
    without looking up any stored id.
    """
    path = f"{root}/{name}/batch={batch_id}"
    df.select(STORE[name].fieldNames()).write.mode("overwrite").parquet(path)
    return path


def read_appended(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_table(spark, root, name).select(STORE[name].fieldNames())


def write_snapshot(df: DataFrame, root: str, name: str, version: int) -> str:
    """A new version of a table beside the ones being read; versions are never overwritten in place."""
    path = f"{root}/{name}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def export_rows(findings: DataFrame, scans: DataFrame, repositories: DataFrame) -> DataFrame:
    """Findings of the newest scan of each URL's newest repository row, in export columns.

    Findings of other scans are left out by a run-time filter where they are read,
    below the joins that they may come from.
    """
    newest = repositories.groupBy("url").agg(F.max("id").alias("repository_id"))
    last = scans.groupBy("repository_id").agg(F.max("id").alias("scan_id"))
    chosen = newest.join(last, "repository_id").select("url", "scan_id")
    exported = might_hold(chosen.select(F.col("scan_id").cast("string")), SCAN_BITS)
    kept = findings.filter(exported(F.col("scan_id").cast("string")))
    return kept.join(chosen, "scan_id").select("url", *EXPORT_COLUMNS)


def export_json(rows: DataFrame, path: str) -> None:
    """JSON lines; NULL fields are kept so that every record has all columns."""
    rows.select(EXPORT_COLUMNS).write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """The nested report as JSON, one record per page. Hash-spread pages keep files even for huge repositories."""
    report.write.mode("errorifexists").json(path)
