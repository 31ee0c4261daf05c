"""Raw quality reports to ``quality_metric`` rows: file figures and project figures from one parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.binding import let
from auditlake.functions.text import strip
from auditlake.plans.quality import assemble, bug_risk, project_metrics
from auditlake.session import written
from auditlake.sinks.store import conform
from auditlake.sources import quality_reports as Q

# Figures of a file, and those that its scanner gives for the whole project.
OF_FILE = {"maintainability_index": "double", "cyclomatic_complexity": "int", "sloc": "int", "lloc": "int", "comments": "int"}
OF_PROJECT = {
    "code_coverage": "double",
    "coupling": "double",
    "cohesion": "double",
    "tests_passing": "bigint",
    "duplicated_lines": "bigint",
    "linter_issues": "bigint",
}


def _figures(**known: Column) -> Column:
    """All figures as one struct, NULL where a dialect has nothing to say."""
    return F.struct(*[known.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in {**OF_FILE, **OF_PROJECT}.items()])


def _fields(parse, *names: str):
    return lambda text: let(parse(text), lambda m: _figures(**{n: m[n] for n in names}))


def _single(parse, name: str):
    return lambda text: _figures(**{name: parse(text)})


# What each tool's report is about, and how it is read.
FILE_TOOLS = {
    "javascript": _fields(Q.javascript, "maintainability_index", "cyclomatic_complexity", "sloc"),
    "ruby": _fields(Q.ruby, "maintainability_index", "cyclomatic_complexity", "sloc"),
    "rust": _fields(Q.rust, *OF_FILE),
    "go": _single(Q.go_complexity, "cyclomatic_complexity"),
}
PROJECT_TOOLS = {
    "coverage": _single(Q.coverage_percent, "code_coverage"),
    "duplication": _single(Q.duplicated_lines, "duplicated_lines"),
    "lint": _single(Q.lint_issues, "linter_issues"),
    "cohesion": _fields(Q.cohesion, "coupling", "cohesion"),
}


def _undecodable(tool: Column, text: Column) -> Column:
    """Documents that are no JSON or XML at all; plain text always is what it is."""
    document = F.when(tool == "rust", F.substring_index(strip(text), "\n", 1)).otherwise(text)
    xml = let(
        F.from_xml(text, F.lit("`_line-rate` string, _corrupt_record string")),
        lambda parsed: parsed.isNull() | parsed["_corrupt_record"].isNotNull(),
    )
    return (
        F.when(text.isNull(), True)
        .when(tool.isin("javascript", "ruby", "rust", "lint", "cohesion"), F.try_parse_json(document).isNull())
        .when(tool == "coverage", xml)
        .otherwise(False)
    )


def parse_quality(reports: DataFrame) -> DataFrame:
    """(scan_id, scanner, tool, path, text) -> (scan_id, scanner, tool, path, reject_reason, figures), one row each.

    The tool picks the dialect in one CASE, so a text is read by its own parser
    only. A text that can't be decoded has the figures of an empty report.
    """
    tool, text = F.col("tool"), F.col("text")
    figures = F.when(F.lit(False), _figures())
    for name, read in {**FILE_TOOLS, **PROJECT_TOOLS}.items():
        figures = figures.when(tool == name, read(text))
    pathless = tool.isin(list(FILE_TOOLS)) & (strip(F.coalesce("path", F.lit(""))) == "")
    reason = (
        F.when(~F.coalesce(tool.isin([*FILE_TOOLS, *PROJECT_TOOLS]), F.lit(False)), "unknown tool")
        .when(pathless, "no path")
        .when(_undecodable(tool, text), "undecodable")
    )
    return reports.select("scan_id", "scanner", "tool", "path", reason.alias("reject_reason"), figures.alias("m")).select(
        "scan_id", "scanner", "tool", "path", "reject_reason", "m.*"
    )


def file_rows(parsed: DataFrame) -> DataFrame:
    """One row per file of a scan; of several reports about it the largest figures count, tool by tool."""
    about = parsed.filter(F.col("tool").isin(list(FILE_TOOLS)) & ~F.coalesce(F.col("reject_reason") == "no path", F.lit(False)))
    figures = [F.coalesce(n, F.lit(0)).cast(kind).alias(n) for n, kind in OF_FILE.items()]
    best = F.max(F.struct("tool", *figures)).alias("m")
    return about.groupBy("scan_id", "path").agg(best).select("scan_id", "path", *[F.col(f"m.{n}").alias(n) for n in OF_FILE])


def project_rows(parsed: DataFrame) -> DataFrame:
    """One row per scan: every scanner that left a report counts, also one without any figure."""
    ran = parsed.filter(F.col("scanner").isNotNull() & ~F.coalesce(F.col("reject_reason") == "unknown tool", F.lit(False)))
    per_scanner = ran.groupBy(F.col("scan_id").alias("repo"), "scanner").agg(*[F.sum(n).alias(n) for n in OF_PROJECT])
    return project_metrics(per_scanner)


def metric_id() -> Column:
    """128-bit id of a file's place in its scan: the same on every rerun."""
    return F.md5(F.concat_ws("|", "scan_id", "path"))


def ingest_quality(reports: DataFrame, churned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of ``quality_metric`` in store schema, rejected reports with their reason).

    ``reports``: (scan_id, scanner, tool, path, text); ``scanner`` is the language
    whose scanner ran the tool, ``path`` the file that a file report is about.
    ``churned``: (scan_id, path, code_churn), 0 where it has no row. Reports are
    parsed once and written; file rows and project rows both read the figures.
    An undecodable report is rejected and leaves zeros, as a scanner without
    output does; one of an unknown tool or without path leaves nothing. Scans
    whose reports are about no file have no row to carry their project figures.
    """
    parsed = written(parse_quality(reports), "parsed-quality")
    rows = file_rows(parsed).withColumnRenamed("scan_id", "repo")
    if churned is None:
        rows = rows.withColumns({"code_churn": F.lit(0), "bug_risk_score": F.lit(0.0)})
    else:  # first, while file rows are still dealt by scan and path
        rows = bug_risk(rows, churned.withColumnsRenamed({"scan_id": "repo", "path": "file"}))
    whole = assemble(rows, project_rows(parsed))
    stored = whole.withColumnsRenamed({"repo": "scan_id"}).withColumn("id", metric_id()).withColumnRenamed("path", "file_path")
    rejects = parsed.filter(F.col("reject_reason").isNotNull()).select("scan_id", "scanner", "tool", "path", "reject_reason")
    return conform(stored, "quality_metric"), rejects

