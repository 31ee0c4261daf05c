"""Dashboards kept up to date: mergeable counts per scan, appended with each ingested batch.

A batch of findings or metric rows leaves a few rows per scan in a folder of its
own, so a rerun replaces them and nothing stored is read. Dashboards sum these
rows; they never look at a finding again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.paths import language_of_path
from auditlake.functions.text import half_up
from auditlake.operators.latest import latest_scans
from auditlake.plans.dashboards import LEVELS, density, names

FOUND = "scan_id bigint, severity string, language string, n bigint, batch string"
SIZED = "scan_id bigint, n bigint, sloc bigint, mi_sum decimal(38,10), mi_n bigint, coverage double, batch string"


def append_findings(findings: DataFrame, root: str, batch_id: str) -> None:
    """Counts of a batch of findings per scan, severity and language."""
    counted = findings.groupBy("scan_id", "severity", language_of_path(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))
    counted.write.mode("overwrite").parquet(f"{root}/found/batch={batch_id}")


def append_metrics(metrics: DataFrame, root: str, batch_id: str) -> None:
    """Sums of a batch of metric rows per scan; decimals, so that sums do not depend on how rows came."""
    index = F.col("maintainability_index").cast("decimal(28,10)")
    sized = metrics.groupBy("scan_id").agg(
        F.count("*").alias("n"),
        F.sum("sloc").alias("sloc"),
        F.sum(index).cast("decimal(38,10)").alias("mi_sum"),
        F.count(index).alias("mi_n"),
        F.max("code_coverage").alias("coverage"),
    )
    sized.write.mode("overwrite").parquet(f"{root}/sized/batch={batch_id}")


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{name}").drop("batch")


def found(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "found", FOUND)


def sized(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "sized", SIZED)


def _latest(counts: DataFrame, scans: DataFrame, keys: list[str], scope: str = "non_quality") -> DataFrame:
    return counts.groupBy("scan_id", *keys).agg(F.sum("n").alias("n")).join(latest_scans(scans, scope), "scan_id")


def findings_by(counts: DataFrame, scans: DataFrame, key: str) -> DataFrame:
    """Findings of latest scans by ``severity`` or ``language``; files without a language are left out of the latter."""
    known = counts.filter(F.col("language").isNotNull()) if key == "language" else counts
    return _latest(known, scans, [key]).groupBy(key).agg(F.sum("n").alias("finding_count"))


def findings_by_repository(counts: DataFrame, scans: DataFrame, repositories: DataFrame, by_language: bool = False) -> DataFrame:
    keys = ["language"] if by_language else []
    known = counts.filter(F.col("language").isNotNull()) if by_language else counts
    totals = _latest(known, scans, keys)
    return totals.join(names(repositories), "repository_id").select("repository_id", "name", *keys, F.col("n").alias("finding_count"))


def quality_by_repository(sizes: DataFrame, scans: DataFrame, repositories: DataFrame) -> DataFrame:
    per_scan = sizes.groupBy("scan_id").agg(F.sum("mi_sum").alias("s"), F.sum("mi_n").alias("m"), F.max("coverage").alias("coverage"))
    mean = F.try_divide(F.col("s").cast("double"), F.col("m").cast("double"))
    joined = per_scan.join(latest_scans(scans, "quality"), "scan_id").join(names(repositories), "repository_id")
    return joined.select(
        "repository_id",
        "name",
        half_up(F.coalesce(mean, F.lit(0.0)), 2).alias("avg_maintainability"),
        half_up(F.coalesce("coverage", F.lit(0.0)), 2).alias("code_coverage"),
    )


def finding_density(counts: DataFrame, sizes: DataFrame, scans: DataFrame, repositories: DataFrame) -> DataFrame:
    """The columns of the full report: lines, findings by level, findings per 1000 lines."""
    level = {name: F.sum(F.when(F.col("severity") == value, F.col("n")).otherwise(0)).alias(name) for value, name in LEVELS.items()}
    per_scan = counts.groupBy("scan_id").agg(F.sum("n").alias("n"), *level.values())
    lines = sizes.groupBy("scan_id").agg(F.sum("sloc").alias("sloc"))
    sides = latest_scans(scans, "any").join(per_scan, "scan_id", "left").join(lines, "scan_id", "left")
    zero, n = F.lit(0).cast("bigint"), F.coalesce("n", F.lit(0).cast("bigint"))
    return sides.join(names(repositories), "repository_id").select(
        "repository_id",
        "name",
        F.col("sloc").alias("total_sloc"),
        n.alias("total_vulnerabilities"),
        *[F.coalesce(c, zero).alias(f"{c}_vulnerabilities") for c in level],
        density(F.col("sloc"), n).alias("per_1000_lines"),
    )
