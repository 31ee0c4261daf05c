"""Dashboard and report aggregates over the latest scans.

Every aggregate counts findings per scan first and joins the counts: a scan that
holds a third of all findings reaches the join as one row per key, and no raw
finding is shuffled by scan id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.paths import language_of_path
from auditlake.functions.text import half_up
from auditlake.operators.latest import latest_scans


def count_latest(findings: DataFrame, scans: DataFrame, keys: list[str], scope: str = "non_quality") -> DataFrame:
    """Findings of latest scans counted per (repository_id, scan_id, *keys), as ``n``."""
    per_scan = findings.groupBy("scan_id", *keys).agg(F.count("*").alias("n"))
    return per_scan.join(latest_scans(scans, scope), "scan_id")


def findings_by_severity(findings: DataFrame, scans: DataFrame, repository_id: int | None = None) -> DataFrame:
    if repository_id is not None:
        scans = scans.filter(F.col("repository_id") == repository_id)
    return count_latest(findings, scans, ["severity"]).groupBy("severity").agg(F.sum("n").alias("finding_count"))


def findings_by_repository(findings: DataFrame, scans: DataFrame, repositories: DataFrame) -> DataFrame:
    counts = count_latest(findings, scans, [])
    return counts.join(names(repositories), "repository_id").select(
        "repository_id", "name", F.col("n").alias("finding_count")
    )


def languages_by_repository(scans: DataFrame, repositories: DataFrame) -> DataFrame:
    """Language list of each latest scan of any type: one aggregation, no join back."""
    newest = F.max_by("languages", "id").alias("languages")
    return (
        scans.groupBy("repository_id")
        .agg(newest)
        .filter(F.size("languages") > 0)
        .join(names(repositories), "repository_id")
        .select("repository_id", "name", "languages")
    )


def _with_language(findings: DataFrame) -> DataFrame:
    return findings.select("scan_id", language_of_path(F.col("file_path")).alias("language")).filter(
        F.col("language").isNotNull()
    )


def findings_by_language(findings: DataFrame, scans: DataFrame) -> DataFrame:
    counts = count_latest(_with_language(findings), scans, ["language"])
    return counts.groupBy("language").agg(F.sum("n").alias("finding_count"))


def findings_by_repository_language(findings: DataFrame, scans: DataFrame, repositories: DataFrame) -> DataFrame:
    counts = count_latest(_with_language(findings), scans, ["language"])
    return counts.join(names(repositories), "repository_id").select(
        "repository_id", "name", "language", F.col("n").alias("finding_count")
    )


def headline_counters(findings: DataFrame, scans: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row of totals: three one-row aggregates, stacked and summed."""

    def counter(df: DataFrame, value: Column, name: str) -> DataFrame:
        return df.agg(value.cast("bigint").alias(name))

    parts = [
        counter(repositories, F.count("*"), "total_repos"),
        counter(scans, F.count("*"), "total_scans"),
        counter(count_latest(findings, scans, []), F.coalesce(F.sum("n"), F.lit(0)), "total_findings"),
    ]
    stacked = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return stacked.agg(*[F.sum(name).alias(name) for name in ("total_repos", "total_scans", "total_findings")])


def quality_by_repository(metrics: DataFrame, scans: DataFrame, repositories: DataFrame) -> DataFrame:
    """Mean maintainability and project coverage of each latest quality scan."""
    per_scan = metrics.groupBy("scan_id").agg(
        F.avg("maintainability_index").alias("mean_mi"), F.max("code_coverage").alias("coverage")
    )
    return (
        per_scan.join(latest_scans(scans, "quality"), "scan_id")
        .join(names(repositories), "repository_id")
        .select(
            "repository_id",
            "name",
            half_up(F.coalesce("mean_mi", F.lit(0.0)), 2).alias("avg_maintainability"),
            half_up(F.coalesce("coverage", F.lit(0.0)), 2).alias("code_coverage"),
        )
    )


LEVELS = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}


def _scan_sides(findings: DataFrame, metrics: DataFrame, scans: DataFrame) -> DataFrame:
    levels = [F.count_if(F.col("severity") == level).alias(name) for level, name in LEVELS.items()]
    found = findings.groupBy("scan_id").agg(F.count("*").alias("n_findings"), *levels)
    sized = metrics.groupBy("scan_id").agg(F.count("*").alias("n_files"), F.sum("sloc").alias("sloc"))
    return latest_scans(scans, "any").join(found, "scan_id", "left").join(sized, "scan_id", "left")


def density(sloc: Column, findings: Column) -> Column:
    ratio = half_up(F.try_divide(findings, sloc) * 1000, 2)
    return F.when(sloc > 0, F.format_string("%.2f", ratio)).otherwise("N/A")


def finding_density(findings: DataFrame, metrics: DataFrame, scans: DataFrame, repositories: DataFrame) -> DataFrame:
    """Lines, findings by level and findings per 1000 lines of each latest scan."""
    n, zero = F.coalesce("n_findings", F.lit(0)), F.lit(0)
    return (
        _scan_sides(findings, metrics, scans)
        .join(names(repositories), "repository_id")
        .select(
            "repository_id",
            "name",
            F.col("sloc").alias("total_sloc"),
            n.alias("total_vulnerabilities"),
            *[F.coalesce(level, zero).alias(f"{level}_vulnerabilities") for level in LEVELS.values()],
            density(F.col("sloc"), n).alias("per_1000_lines"),
        )
    )


def finding_density_fan_out(
    findings: DataFrame, metrics: DataFrame, scans: DataFrame, repositories: DataFrame
) -> DataFrame:
    """The same report with the sums a findings x metrics fan-out per scan gives.

    Joining both sides to one scan repeats each finding per metric row and back.
    The inflated sums follow from the per-side counts, so no fan-out is run.
    """
    n, files = F.coalesce("n_findings", F.lit(0)), F.coalesce("n_files", F.lit(0))
    per_file, per_finding = F.greatest(files, F.lit(1)), F.greatest(n, F.lit(1))
    return (
        _scan_sides(findings, metrics, scans)
        .join(names(repositories), "repository_id")
        .groupBy("name")
        .agg(
            F.sum(F.col("sloc") * per_finding).alias("total_sloc"),
            F.sum(n * per_file).alias("total_vulnerabilities"),
            *[
                F.sum(F.coalesce(level, F.lit(0)) * per_file).alias(f"{level}_vulnerabilities")
                for level in LEVELS.values()
            ],
        )
        .withColumn("per_1000_lines", density(F.col("total_sloc"), F.col("total_vulnerabilities")))
    )


def top_descriptions(findings: DataFrame, scans: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent descriptions of latest scans.

    Descriptions are many, so counting them per scan first would combine little:
    findings are restricted to latest scans before they are described or shuffled.
    """
    return (
        findings.join(latest_scans(scans, "any").select("scan_id"), "scan_id", "left_semi")
        .groupBy("description")
        .agg(F.count("*").alias("finding_count"))
        .orderBy(F.desc("finding_count"), "description")
        .limit(k)
    )


def top_repositories(findings: DataFrame, scans: DataFrame, repositories: DataFrame, k: int = 5) -> DataFrame:
    """The k repositories with most findings; names are looked up for those k only."""
    top = (
        count_latest(findings, scans, [], "any")
        .select("repository_id", F.col("n").alias("finding_count"))
        .orderBy(F.desc("finding_count"), "repository_id")
        .limit(k)
    )
    return (
        top.join(names(repositories), "repository_id")
        .select("repository_id", "name", "finding_count")
        .orderBy(F.desc("finding_count"), "repository_id")
    )


def recent_scans(scans: DataFrame, k: int | None = 5) -> DataFrame:
    ordered = scans.orderBy(F.desc("created_at"), F.desc("id"))
    return ordered if k is None else ordered.limit(k)


def names(repositories: DataFrame) -> DataFrame:
    return repositories.select(F.col("id").alias("repository_id"), "name")
