"""The write path: raw reports -> stored findings and rejects, one plan per batch of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.paths import relative_path
from auditlake.functions.severity import map_severity
from auditlake.operators import joins
from auditlake.session import written
from auditlake.sinks.store import conform
from auditlake.sources.reports import parse_reports, rejected_reports, reported_findings


def finding_id() -> Column:
    """128-bit id of a finding's place in its report: the same on every rerun."""
    return F.md5(F.concat_ws("|", "scan_id", "tool", "report_path", "position"))


def to_store(findings: DataFrame) -> DataFrame:
    """Findings with every store column, in order; status starts as 'new'."""
    if "status" not in findings.columns:
        findings = findings.withColumn("status", F.lit("new"))
    return conform(findings, "findings")


def normalise(parsed: DataFrame, root: str = "") -> DataFrame:
    """Ids, relative paths and stored severities; misconfigurations keep no severity."""
    findings = reported_findings(parsed).withColumn("id", finding_id())
    if root:
        findings = findings.withColumn("file_path", relative_path(F.col("file_path"), root))
    severity = F.when(F.col("tool") != "misconfiguration", map_severity(F.col("severity")))
    return findings.withColumn("severity", severity)


# Reports whose findings are stored as they are: nothing in them is a line of a source file.
UNCHECKED = ["misconfiguration"]
VERDICT_KEYS = ["description", "code_snippet"]


def accept(
    parsed: DataFrame,
    files: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    root: str = "",
    checkout: str = "scan_id",
) -> DataFrame:
    """Parsed reports to findings with a ``reject_reason``; NULL there means accepted.

    Order of the steps: verdicts, file and line check, withheld snippets.
    ``verdicts`` are keyed by description and snippet, and by ``checkout`` too where
    they have that column. Misconfigurations take none of the steps.
    """
    findings = normalise(parsed, root)
    unchecked = F.col("tool").isin(UNCHECKED)
    plain = findings.filter(unchecked).withColumn("reject_reason", F.lit(None).cast("string"))
    findings = findings.filter(~unchecked)
    if verdicts is not None:
        scope = [checkout] if checkout in verdicts.columns else []
        findings = joins.suppress(findings, verdicts, [*scope, *VERDICT_KEYS])
    if files is None:
        return findings.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(plain)
    checked = written(joins.check_source(findings, files, checkout), "checked-findings")
    return joins.fill_snippets(checked, files, checkout).unionByName(plain)


def ingest(
    reports: DataFrame,
    files: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    root: str = "",
    checkout: str = "scan_id",
) -> DataFrame:
    """``accept`` for raw reports; a report is one row and is parsed by one task, whatever its size."""
    return accept(parse_reports(reports), files, verdicts, root, checkout)


def ingest_all(reports: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(findings as of ``ingest``, rejected reports with their reason) from one parse, written once."""
    parsed = written(parse_reports(reports), "parsed-reports")
    return accept(parsed, **options), rejected_reports(parsed)
