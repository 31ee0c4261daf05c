"""Registered dashboard and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.plans import dashboards as D
from auditlake.plans import partials
from auditlake.session import shared_path
from auditlake.sources.adapters import Host


def findings_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.findings_by_severity(host.lines(), host.scans())


def findings_by_repository(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.findings_by_repository(host.lines(), host.scans(), host.repositories())


def languages_by_repository(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    found = D.languages_by_repository(host.scans(), host.repositories())
    return found.withColumn("languages", F.array_join("languages", ","))


def findings_by_language(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.findings_by_language(host.lines(), host.scans())


def findings_by_repository_language(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.findings_by_repository_language(host.lines(), host.scans(), host.repositories())


def headline_counters(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.headline_counters(host.lines(), host.scans(), host.repositories())


def quality_by_repository(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.quality_by_repository(host.metrics(), host.scans(), host.repositories())


def finding_density(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.finding_density(host.lines(), host.metrics(), host.scans(), host.repositories())


def _kept_up(host: Host) -> str:
    """Partials of the hosted findings and metrics, ingested as three batches of which one runs twice."""
    root = shared_path(host.spark, "partials")
    part = F.pmod(F.col("scan_id"), F.lit(3))
    for k in (0, 1, 2, 1):
        partials.append_findings(host.lines().filter(part == k), root, str(k))
        partials.append_metrics(host.metrics().filter(part == k), root, str(k))
    return root


def finding_density_kept_up(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    root = _kept_up(host)
    return partials.finding_density(partials.found(spark, root), partials.sized(spark, root), host.scans(), host.repositories())


def findings_by_language_kept_up(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return partials.findings_by(partials.found(spark, _kept_up(host)), host.scans(), "language")


def finding_density_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.finding_density_fan_out(host.lines(), host.metrics(), host.scans(), host.repositories())


def top_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.top_descriptions(host.findings(), host.scans())


def top_repositories(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return D.top_repositories(host.lines(), host.scans(), host.repositories())


def _shown(scans: DataFrame) -> DataFrame:
    created = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    return scans.select("id", "repository_id", "scan_type", "status", created)


def recent_scans(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(D.recent_scans(Host(spark, folder).scans()))


def scans_newest_first(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(D.recent_scans(Host(spark, folder).scans(), None))


QUERIES = [
    findings_by_severity,
    findings_by_repository,
    languages_by_repository,
    findings_by_language,
    findings_by_repository_language,
    headline_counters,
    quality_by_repository,
    finding_density,
    finding_density_kept_up,
    findings_by_language_kept_up,
    finding_density_fan_out,
    top_descriptions,
    top_repositories,
    recent_scans,
    scans_newest_first,
]
