"""Finding lists: filters, drill-down, description parts, sorts, per-file view, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.functions.severity import severity_ordinal

CONFIDENT = 0.7


def filter_findings(
    findings: DataFrame,
    scans: DataFrame | None = None,
    repository_id: int | None = None,
    scan_id: int | None = None,
    severity: str | None = None,
    scanner: str | None = None,
    keyword: str | None = None,
) -> DataFrame:
    """All given conditions together; each is a plain predicate that reaches the scan."""
    if repository_id is not None:
        if scans is None:
            raise ValueError("a repository filter needs the scan table")
        of_repository = scans.filter(F.col("repository_id") == repository_id).select(F.col("id").alias("scan_id"))
        findings = findings.join(of_repository, "scan_id", "left_semi")
    if scan_id is not None:
        findings = findings.filter(F.col("scan_id") == scan_id)
    if severity is not None:
        findings = findings.filter(F.col("severity") == severity)
    if scanner is not None:
        findings = findings.filter(text.from_scanner(F.col("description"), scanner))
    if keyword is not None:
        findings = findings.filter(text.has_keyword(F.col("description"), keyword))
    return findings


def newest_first(findings: DataFrame) -> DataFrame:
    """Hash ids carry no time, so newer scans come first and the id breaks ties."""
    return findings.orderBy(F.desc("scan_id"), F.desc("id"))


def with_description(findings: DataFrame, description: str) -> DataFrame:
    return findings.filter(F.col("description") == description)


def describe(findings: DataFrame) -> DataFrame:
    description = F.col("description")
    return findings.withColumns(
        {
            "description_text": text.description_text(description),
            "description_url": text.description_url(description),
            "rule_id": text.rule_id(description),
        }
    )


def confident(findings: DataFrame, threshold: float = CONFIDENT, strict: bool = False) -> DataFrame:
    """Keep findings at or above the threshold (strictly above for patch candidates)."""
    score = F.coalesce("confidence_score", F.lit(0.0))
    return findings.filter(score > threshold if strict else score >= threshold)


def sort_findings(findings: DataFrame, by: str = "severity", order: str = "desc") -> DataFrame:
    """Severity goes by its ordinal, so the default 'desc' starts with the least severe."""
    keys = {"severity": severity_ordinal(F.col("severity")), "file": F.col("file_path")}
    if by not in keys:
        return findings
    return findings.orderBy(_directed(keys[by], order), "scan_id", "id")


def sort_metrics(metrics: DataFrame, by: str = "file_path", order: str = "asc") -> DataFrame:
    """Any stored column may be named; an unknown one falls back to the file path.

    The tie-breaks also let a range-partitioned sort cut between equal values.
    """
    ties = [c for c in ("file_path", "id") if c in metrics.columns and c != by]
    return metrics.orderBy(_directed(F.col(by if by in metrics.columns else "file_path"), order), *ties)


def _directed(key: Column, order: str) -> Column:
    return key.desc_nulls_last() if order == "desc" else key.asc_nulls_last()


# Fixed value: the group of findings without a file.
PATHLESS = "General"
SALTS = 16


def file_group(path: Column) -> Column:
    return F.coalesce(F.nullif(path, F.lit("")), F.lit(PATHLESS))


def scan_files(findings: DataFrame) -> DataFrame:
    """Per scan and file the number of findings, next to the scan's total."""
    per_file = findings.groupBy("scan_id", file_group(F.col("file_path")).alias("file_group")).agg(
        F.count("*").alias("file_findings")
    )
    totals = per_file.groupBy("scan_id").agg(F.sum("file_findings").alias("scan_findings"))
    return per_file.join(totals, "scan_id")


def scan_listing(findings: DataFrame) -> DataFrame:
    """Every finding with its file group and that group's size.

    The counts come from a grouped join rather than a window. Findings of a file are
    bounded by the file; the pathless ones of a scan are not, so they are dealt over
    ``SALTS`` keys and their one count is repeated for each.
    """
    pathless = F.col("file_group") == PATHLESS
    salts = F.when(pathless, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    counts = scan_files(findings).withColumn("_salt", F.explode(salts))
    salt = F.when(pathless, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    grouped = findings.withColumn("file_group", file_group(F.col("file_path"))).withColumn("_salt", salt)
    return grouped.join(counts, ["scan_id", "file_group", "_salt"]).drop("_salt")


def tool_totals(findings: DataFrame) -> DataFrame:
    """Findings per scan and tool; the tool is what precedes the description's colon."""
    tool = F.lower(F.substring_index("description", ":", 1))
    return findings.groupBy("scan_id", tool.alias("tool")).agg(F.count("*").alias("finding_count"))


def gate(findings: DataFrame, severity: str = "HIGH") -> DataFrame:
    """One row: all findings, those of one severity, and whether the gate passes."""
    return findings.agg(
        F.count("*").alias("finding_count"),
        F.count_if(F.col("severity") == severity).alias("severe_count"),
        (F.count("*") == 0).alias("passed"),
    )
