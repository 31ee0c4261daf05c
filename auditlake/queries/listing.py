"""Registered queries: finding lists, description parts, URLs, path predicates, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import paths, text
from auditlake.functions.severity import map_severity, severity_ordinal
from auditlake.operators.latest import last_scan_by_time
from auditlake.plans import findings as L
from auditlake.plans import inventory as I
from auditlake.plans import texts
from auditlake.sources.adapters import Host

_LISTED = ["id", "scan_id", "file_path", "line_number", "description", "severity"]


def findings_filtered(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    found = L.filter_findings(host.findings(), severity="HIGH", scanner="Semgrep")
    return L.newest_first(found).select(_LISTED)


def findings_of_repository(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return L.newest_first(L.filter_findings(host.findings(), host.scans(), repository_id=7)).select(_LISTED)


def findings_with_description(spark: SparkSession, folder: str) -> DataFrame:
    return L.with_description(Host(spark, folder).findings(), "Gitleaks: red widget").select(_LISTED)


def findings_with_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return L.filter_findings(Host(spark, folder).findings(), keyword="WIDGET").select(_LISTED)


def severity_mapping(spark: SparkSession, folder: str) -> DataFrame:
    raw = Host(spark, folder).table("lineitem").select(Host.raw_level().alias("raw"))
    mapped = raw.select("raw", map_severity(F.col("raw")).alias("severity"))
    return mapped.groupBy("raw", "severity").agg(F.count("*").alias("n"))


def path_languages(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    files = host.inventory().select(F.col("repo").cast("string").alias("repo"), "path").unionByName(host.page_paths())
    return files.select("repo", "path", paths.language_of_path(F.col("path")).alias("language"))


def finding_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    parts = ["id", "description_text", "description_url", "rule_id"]
    return L.describe(Host(spark, folder).findings()).select(parts)


def confident_findings(spark: SparkSession, folder: str) -> DataFrame:
    return L.confident(Host(spark, folder).lines()).select("id", "confidence_score")


def patch_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return L.confident(Host(spark, folder).lines(), strict=True).select("id", "confidence_score")


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    return Host(spark, folder).inventory().filter(paths.is_source_file(F.col("path")))


def source_files_with_tests(spark: SparkSession, folder: str) -> DataFrame:
    return Host(spark, folder).inventory().filter(paths.is_source_file(F.col("path"), include_tests=True))


def config_files(spark: SparkSession, folder: str) -> DataFrame:
    return Host(spark, folder).inventory().filter(paths.is_config_file(F.col("path")))


def config_inputs(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return texts.config_inputs(host.inventory(), host.inventory_contents(), "repo")


def repository_urls(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    pages = F.explode(F.array(url, F.replace(url, F.lit(".git"), F.lit("/tree/dev/x")), F.replace(url, F.lit(".git"))))
    return (
        Host(spark, folder)
        .repositories()
        .select("id", pages.alias("url"))
        .select(
            "id",
            "url",
            text.clone_url(url).alias("clone_url"),
            text.url_branch(url).alias("branch"),
            text.repository_name(text.clone_url(url)).alias("name"),
            text.push_url(url).alias("push_url"),
        )
    )


def log_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    documents = Host(spark, folder).table("documents")
    return documents.select("doc_id", text.strict_log_verdict(F.col("text")).alias("tests_passed"))


def relative_paths(spark: SparkSession, folder: str) -> DataFrame:
    root = "/work/checkout/src"
    path = F.concat(F.lit("/work/checkout/"), Host.line_path())
    outside = F.when(F.col("l_linestatus") == "O", path).otherwise(Host.line_path())
    rows = Host(spark, folder).table("lineitem").select(Host.line_id().alias("id"), outside.alias("path"))
    return rows.select("id", paths.relative_path(F.col("path"), root).alias("file_path"))


def findings_by_severity_order(spark: SparkSession, folder: str) -> DataFrame:
    found = L.sort_findings(Host(spark, folder).lines())
    return found.select("id", "scan_id", "severity", severity_ordinal(F.col("severity")).alias("severity_rank"))


def quality_rows_sorted(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.sort_metrics(Host(spark, folder).metrics(), "sloc", "desc")
    return rows.select("id", "scan_id", "file_path", "sloc")


def last_quality_scans(spark: SparkSession, folder: str) -> DataFrame:
    return _dated(last_scan_by_time(Host(spark, folder).scans(), "quality"))


def last_deep_scans(spark: SparkSession, folder: str) -> DataFrame:
    return _dated(last_scan_by_time(Host(spark, folder).scans(), "deep"))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def _pathless(spark: SparkSession, folder: str) -> DataFrame:
    """Findings whose sixth and seventh lines carry no path, as advisory findings do."""
    path = F.when(F.col("line_number") == 7, None).when(F.col("line_number") == 6, "").otherwise(F.col("file_path"))
    return Host(spark, folder).lines().withColumn("file_path", path)


def scan_file_groups(spark: SparkSession, folder: str) -> DataFrame:
    return L.scan_files(_pathless(spark, folder))


def scan_listing(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.scan_listing(_pathless(spark, folder))
    return rows.select("id", "scan_id", "file_group", "file_findings", "scan_findings")


def tool_totals(spark: SparkSession, folder: str) -> DataFrame:
    return L.tool_totals(Host(spark, folder).findings())


def finding_gate(spark: SparkSession, folder: str) -> DataFrame:
    return L.gate(Host(spark, folder).lines())


def language_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ranked = I.language_ranking(Host(spark, folder).inventory())
    return ranked.withColumn("languages", F.array_join("languages", ","))


def work_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return I.work_estimate(Host(spark, folder).inventory())


def page_work_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return I.work_estimate(Host(spark, folder).page_paths())


def files_after_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    repositories = host.repositories().select(F.col("id").alias("repo"), "sast_exclusions")
    return I.without_exclusions(host.inventory(), repositories)


QUERIES = [
    findings_filtered,
    findings_of_repository,
    findings_with_description,
    findings_with_keyword,
    severity_mapping,
    path_languages,
    finding_descriptions,
    confident_findings,
    patch_candidates,
    source_files,
    source_files_with_tests,
    config_files,
    config_inputs,
    repository_urls,
    log_verdicts,
    relative_paths,
    findings_by_severity_order,
    quality_rows_sorted,
    last_quality_scans,
    last_deep_scans,
    scan_file_groups,
    scan_listing,
    tool_totals,
    finding_gate,
    language_ranking,
    work_estimate,
    page_work_estimate,
    files_after_exclusions,
]
