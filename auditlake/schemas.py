"""Explicit schemas of the findings store and of one parsed finding."""

from __future__ import annotations

from pyspark.sql import types as T

_BOOL, _DOUBLE, _INT, _LONG, _STR, _TS = (
    T.BooleanType(),
    T.DoubleType(),
    T.IntegerType(),
    T.LongType(),
    T.StringType(),
    T.TimestampType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


REPOSITORY = _schema(
    id=_LONG,
    name=_STR,
    url=_STR,
    primary_branch=_STR,
    last_commit_hash=_STR,
    needs_scan=_BOOL,
    periodic_scan_enabled=_BOOL,
    periodic_scan_interval=_INT,
    sast_exclusions=_STR,
    test_command=_STR,
    python_version=_STR,
    test_container=_STR,
    run_tests_in_container=_BOOL,
    use_venv=_BOOL,
)

SCAN = _schema(
    id=_LONG,
    repository_id=_LONG,
    scan_type=_STR,
    status=_STR,
    status_message=_STR,
    triggering_commit_hash=_STR,
    job_id=_STR,
    branch=_STR,
    test_output=_STR,
    progress=_INT,
    total_progress=_INT,
    created_at=_TS,
    auto_patch_enabled=_BOOL,
    generate_test_script=_BOOL,
    languages=T.ArrayType(_STR),
)

# Finding ids are 128-bit hashes of where a finding was read (see sinks.store),
# so that a rerun yields the same ids without a database sequence.
FINDINGS = _schema(
    id=_STR,
    scan_id=_LONG,
    file_path=_STR,
    line_number=_INT,
    code_snippet=_STR,
    description=_STR,
    severity=_STR,
    confidence_score=_DOUBLE,
    status=_STR,
    cve_id=_STR,
    description_text=_STR,
    description_url=_STR,
    rule_id=_STR,
)

EVIDENCE = _schema(id=_STR, finding_id=_STR, type=_STR, content=_STR)
PATCH = _schema(id=_STR, finding_id=_STR, generated_patch_diff=_STR, pull_request_url=_STR)

QUALITY_METRIC = _schema(
    id=_STR,
    scan_id=_LONG,
    file_path=_STR,
    cyclomatic_complexity=_INT,
    code_churn=_INT,
    sloc=_INT,
    lloc=_INT,
    comments=_INT,
    halstead_volume=_DOUBLE,
    maintainability_index=_DOUBLE,
    bug_risk_score=_DOUBLE,
    code_coverage=_DOUBLE,
    coupling=_DOUBLE,
    cohesion=_DOUBLE,
    tests_passing=_INT,
    duplicated_lines=_INT,
    linter_issues=_INT,
)

QUALITY_INTERPRETATION = _schema(id=_STR, quality_metric_id=_STR, interpretation=_STR)

CHAT_MESSAGE = _schema(
    id=_STR,
    finding_id=_STR,
    quality_interpretation_id=_STR,
    message=_STR,
    sender=_STR,
    created_at=_TS,
)

STORE = {
    "repository": REPOSITORY,
    "scan": SCAN,
    "findings": FINDINGS,
    "evidence": EVIDENCE,
    "patch": PATCH,
    "quality_metric": QUALITY_METRIC,
    "quality_interpretation": QUALITY_INTERPRETATION,
    "chat_message": CHAT_MESSAGE,
}

# The exported columns of a finding, in export order.
EXPORT_COLUMNS = [
    "id",
    "scan_id",
    "file_path",
    "line_number",
    "code_snippet",
    "description",
    "severity",
    "confidence_score",
    "status",
    "cve_id",
]

# The states of a scan.
SCAN_STATUSES = ["queued", "running", "completed", "failed"]

FINDING_IN = _schema(
    file_path=_STR,
    line_number=_INT,
    code_snippet=_STR,
    description=_STR,
    severity=_STR,
    confidence_score=_DOUBLE,
    cve_id=_STR,
)
