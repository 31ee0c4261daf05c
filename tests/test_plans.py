"""Plan shapes and identities that hold whatever the data."""

import inspect
import pkgutil
import re

import pytest
from pyspark.sql import functions as F

import auditlake
from auditlake.plans import dashboards as D
from auditlake.queries.registry import queries
from auditlake.session import shared_root
from auditlake.sources.adapters import Host

QUERIES = queries()
LAZY = [
    name
    for name in sorted(QUERIES)
    if not name.endswith("_stream") and name not in {"appended_findings", "stored_tables", "file_inventory"}
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_in_plans_and_no_cartesian_product(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["quality_by_repository"](spark, sf_dir))
    assert "EqualTo(l_linestatus,O)" in text
    assert "l_shipdate" not in text
    assert "p_name" not in plan(QUERIES["findings_by_severity"](spark, sf_dir))


def test_repository_filter_reaches_the_scan(spark, sf_dir):
    host = Host(spark, sf_dir)
    assert "EqualTo(o_custkey,7)" in plan(D.findings_by_severity(host.lines(), host.scans(), 7))


def test_counts_are_combined_before_they_are_joined(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["findings_by_repository"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    findings_side = text[: text.index("lineitem.parquet")].splitlines()
    assert any("partial_count" in line for line in findings_side[-6:])


def test_no_hints_collects_or_local_checkpoints_in_the_package():
    for module in pkgutil.walk_packages(auditlake.__path__, "auditlake."):
        if module.name.startswith("auditlake.llm"):
            continue  # a part of its own, whose broadcasts are bounded by parameters
        source = inspect.getsource(__import__(module.name, fromlist=["_"]))
        assert not re.search(r"\.collect\(\)|toPandas|localCheckpoint|broadcast\(|crossJoin|\.hint\(", source), module.name


def test_results_hold_without_any_broadcast(spark, sf_dir):
    def rows(name):
        return sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()), key=repr)

    names = ["finding_density", "source_checks", "linked_cves", "duplicated_lines_by_file", "reconciled_scans"]
    usual = {name: rows(name) for name in names}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {name: rows(name) for name in names} == usual
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def total(df, column="finding_count"):
    return df.agg(F.sum(column)).first()[0]


def test_totals_agree(spark, sf_dir):
    (headline,) = QUERIES["headline_counters"](spark, sf_dir).collect()
    assert total(QUERIES["findings_by_severity"](spark, sf_dir)) == headline.total_findings
    assert total(QUERIES["findings_by_repository"](spark, sf_dir)) == headline.total_findings
    by_language = {row.language: row.finding_count for row in QUERIES["findings_by_language"](spark, sf_dir).collect()}
    summed = QUERIES["findings_by_repository_language"](spark, sf_dir).groupBy("language").agg(F.sum("finding_count"))
    assert by_language == {row[0]: row[1] for row in summed.collect()}


def test_density_is_not_inflated_by_the_other_side(spark):
    repositories = spark.createDataFrame([(1, "r"), (2, "empty")], "id bigint, name string")
    scans = spark.createDataFrame([(5, 1, "deep"), (6, 2, "deep")], "id bigint, repository_id bigint, scan_type string")
    findings = spark.createDataFrame([(5, "HIGH"), (5, "LOW"), (5, "LOW")], "scan_id bigint, severity string")
    metrics = spark.createDataFrame([(5, 600), (5, 400)], "scan_id bigint, sloc int")
    args = (findings, metrics, scans, repositories)
    fixed = {row.name: row for row in D.finding_density(*args).collect()}
    assert (fixed["r"].total_sloc, fixed["r"].total_vulnerabilities, fixed["r"].per_1000_lines) == (1000, 3, "3.00")
    assert (fixed["empty"].total_sloc, fixed["empty"].per_1000_lines) == (None, "N/A")
    fanned = {row.name: row for row in D.finding_density_fan_out(*args).collect()}
    assert (fanned["r"].total_sloc, fanned["r"].total_vulnerabilities, fanned["r"].low_vulnerabilities) == (3000, 6, 4)


def test_scan_without_a_type_is_in_no_restricted_scope(spark):
    from auditlake.operators.latest import latest_scans

    scans = spark.createDataFrame([(1, 1, "deep"), (2, 1, None), (3, 1, "quality")], "id bigint, repository_id bigint, scan_type string")
    newest = {scope: latest_scans(scans, scope).first().scan_id for scope in ("any", "non_quality", "quality")}
    assert newest == {"any": 3, "non_quality": 1, "quality": 3}


def test_shared_folder_is_the_sessions(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_reports_are_spelled_in_methods_that_a_jvm_compiles(spark, sf_dir, capsys):
    """Methods over 8000 bytes stay interpreted."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        Host(spark, sf_dir).reports().explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
