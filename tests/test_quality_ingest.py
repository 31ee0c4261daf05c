"""Literal quality reports to stored rows, and configuration files with something in them."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake.plans import quality_ingest, texts
from auditlake.schemas import STORE
from auditlake.sources import quality_reports

REPORTS = "scan_id bigint, scanner string, tool string, path string, text string"
JS = json.dumps({"summary": {"reports": [{"complexity": {"maintainability": 61.5, "cyclomatic": 7, "sloc": 40}}]}})
RUBY = json.dumps({"analysed_modules": [{"rating": "B", "lines_of_code": 12, "methods": [{"complexity": 2.5}, {"complexity": 4}]}]})
RUST = json.dumps({"metrics": {"cyclomatic": {"sum": 9}, "mi": {"mi_original": 80.5}}, "spaces": [{"metrics": {"loc": 30, "lloc": 20, "comments": 4}}]})


@pytest.fixture
def ingested(spark):
    rows = [
        (1, "JavaScript", "javascript", "a.js", JS),
        (1, "Ruby", "ruby", "b.rb", RUBY),
        (1, "Rust", "rust", "c.rs", RUST + "\n{broken"),
        (1, "Go", "go", "d.go", "3 main f d.go:1:1\n4 main g d.go:9:1\n"),
        (1, "JavaScript", "javascript", "cut.js", JS[:20]),
        (1, "JavaScript", "javascript", " ", JS),
        (1, "Python", "coverage", None, '<coverage line-rate="0.5"></coverage>'),
        (1, "Python", "duplication", None, "Found a 5 line duplication\nFound a 6 line duplication"),
        (1, "Python", "lint", None, "[{}, {}]"),
        (1, "Python", "cohesion", None, '{"m": {"lcom4": 2, "ic": 6}}'),
        (1, "Python", "coverage", None, "<coverage"),
        (1, "Python", "mystery", None, "x"),
        (1, "Python", None, None, None),
        (2, "JavaScript", "javascript", "a.js", None),
        (3, "Python", "lint", None, "[{}]"),
    ]
    churned = spark.createDataFrame([(1, "a.js", 3), (9, "a.js", 8)], "scan_id bigint, path string, code_churn bigint")
    return quality_ingest.ingest_quality(spark.createDataFrame(rows, REPORTS), churned)


def test_file_rows_carry_their_scans_project_figures(ingested):
    stored, _ = ingested
    assert stored.schema.fieldNames() == STORE["quality_metric"].fieldNames()
    rows = {(r.scan_id, r.file_path): r for r in stored.collect()}
    assert set(rows) == {(1, "a.js"), (1, "b.rb"), (1, "c.rs"), (1, "d.go"), (1, "cut.js"), (2, "a.js")}
    figures = {k[1]: (r.maintainability_index, r.cyclomatic_complexity, r.sloc, r.lloc, r.comments) for k, r in rows.items() if k[0] == 1}
    assert figures == {
        "a.js": (61.5, 7, 40, 0, 0),
        "b.rb": (80.0, 6, 12, 0, 0),
        "c.rs": (80.5, 9, 30, 20, 4),
        "d.go": (0.0, 7, 0, 0, 0),
        "cut.js": (0.0, 0, 0, 0, 0),
    }
    one = rows[1, "a.js"]
    assert (one.code_coverage, one.coupling, one.cohesion) == (10.0, 1.2, 0.4)  # of five scanners
    assert (one.duplicated_lines, one.linter_issues, one.tests_passing) == (11, 2, 0)
    assert (one.code_churn, one.bug_risk_score) == (3, 21.0) and rows[1, "b.rb"].code_churn == 0
    two = rows[2, "a.js"]
    assert (two.maintainability_index, two.code_coverage, two.linter_issues) == (0.0, 0.0, 0)
    assert len({r.id for r in rows.values()}) == len(rows)


def test_rejects_name_their_reason(ingested):
    _, rejects = ingested
    assert sorted((r.scan_id, r.tool or "", r.path or "", r.reject_reason) for r in rejects.collect()) == [
        (1, "", "", "unknown tool"),
        (1, "coverage", "", "undecodable"),
        (1, "javascript", " ", "no path"),
        (1, "javascript", "cut.js", "undecodable"),
        (1, "mystery", "", "unknown tool"),
        (2, "javascript", "a.js", "undecodable"),
    ]


def test_a_rerun_gives_the_same_rows(spark):
    reports = spark.createDataFrame([(1, "Go", "go", "a.go", "3 f"), (1, "Go", "go", "a.go", "3 f")], REPORTS)
    first, second = (quality_ingest.ingest_quality(reports)[0].collect() for _ in range(2))
    assert first == second and len(first) == 1
    assert quality_ingest.ingest_quality(reports.limit(0))[0].count() == 0


def test_blank_configuration_files_are_left_out(spark):
    files = [("r", "a/Dockerfile", "FROM x"), ("r", "b/Dockerfile", " \n\t"), ("r", "c/values.yaml", None), ("r", "d.py", "x = 1"), ("s", "a/Dockerfile", "")]
    inputs = texts.config_inputs(
        spark.createDataFrame([(r, p) for r, p, _ in files] + [("r", "a/Dockerfile")], "repo string, path string"),
        spark.createDataFrame(files, "repo string, path string, content string"),
        "repo",
    )
    assert [tuple(r) for r in inputs.collect()] == [("r", "a/Dockerfile", "FROM x")]


def test_lint_records_are_counted_as_they_are_decoded(spark):
    texts = ["[]", "[1, 2]", '[{"a": 1}, null]', "['x', \"y\"]", "[NaN, 1]", "[1] x", "[1, 2", "[1,]", "[,]", "[[1], [2, 3]]", ' [1]', "\n[1,\n2]\n", '["a\nb"]', "\x0b[1]", "﻿[1]", "oops", "", " ", None, "null", "5", '{"a": [1]}', "'[1]'", "]", "\\", "[01]", "[+1]", "[Infinity]", '["\\q"]', "[a]", "/* c */[1]", "[tru]"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    decoded = F.greatest(F.coalesce(F.size(F.from_json("t", "array<string>")), F.lit(0)), F.lit(0))
    rows = table.select("t", quality_reports.lint_issues(F.col("t")).alias("n"), decoded.alias("d")).collect()
    assert [(r.t, r.n) for r in rows] == [(r.t, r.d) for r in rows]
    assert {r.t: r.n for r in rows}["[[1], [2, 3]]"] == 2


def test_file_rows_meet_their_churn_where_they_are(spark):
    """File rows move to their file and to their scan, and not a third time."""
    reports = [(1, "Go", "go", f"f{i % 2}", "3 main f a.go:1:1") for i in range(3)] + [(2, "Go", "go", "f0", "4 x"), (None, "Go", "go", "f0", "5 x"), (1, "Go", "coverage", None, '<coverage line-rate="0.5"/>')]
    table = spark.createDataFrame(reports, "scan_id long, scanner string, tool string, path string, text string")
    churned = spark.createDataFrame([(1, "f0", 2), (1, "f1", 3), (1, "f1", 4), (None, "f0", 9)], "scan_id long, path string, code_churn long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = quality_ingest.ingest_quality(table, churned)
        got = rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    figures = sorted(str((r.scan_id, r.file_path, r.code_coverage, r.code_churn, r.bug_risk_score)) for r in got)
    assert figures == [
        "(1, 'f0', 50.0, 2, 6.0)",
        "(1, 'f1', 50.0, 3, 9.0)",
        "(1, 'f1', 50.0, 4, 12.0)",
        "(2, 'f0', 0.0, 0, 0.0)",
        "(None, 'f0', None, 0, 0.0)",
    ]
    assert plan.count("Exchange hashpartitioning(") <= 5
