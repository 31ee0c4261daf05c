"""Literal scanner and quality reports."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake.sources import quality_reports as Q
from auditlake.sources import reports as R


def parse(spark, tool, text):
    raw = spark.createDataFrame([(1, tool, "r", text)], "scan_id bigint, tool string, path string, text string")
    return R.parse_reports(raw)


def findings(spark, tool, document):
    text = document if isinstance(document, str) else json.dumps(document)
    return [row.asDict() for row in R.reported_findings(parse(spark, tool, text)).orderBy("position").collect()]


# Two findings a report, but for one tool: (document, rows as read from it).
CASES = {
    "semgrep": (
        {
            "results": [
                {
                    "check_id": f"sql.unsafe-{kind}",
                    "path": f"shop/{kind}.py",
                    "start": {"line": line},
                    "extra": {"lines": f"run({kind})", "message": f"{kind} reaches a statement", "severity": level},
                }
                for kind, line, level in (("order", 31, "ERROR"), ("cart", 7, "INFO"))
            ]
        },
        [
            ("shop/order.py", 31, "run(order)", "semgrep: order reaches a statement (https://semgrep.dev/r/sql.unsafe-order)", "ERROR"),
            ("shop/cart.py", 7, "run(cart)", "semgrep: cart reaches a statement (https://semgrep.dev/r/sql.unsafe-cart)", "INFO"),
        ],
    ),
    "bandit": (
        {
            "results": [
                {
                    "test_id": number,
                    "filename": "jobs/nightly.py",
                    "line_number": line,
                    "code": "call()",
                    "issue_text": text,
                    "issue_severity": level,
                }
                for number, line, text, level in (("B602", 88, "Shell in use", "MEDIUM"), ("B301", 2, "Pickle read", "LOW"))
            ]
        },
        [
            ("jobs/nightly.py", 88, "call()", "bandit: Shell in use (https://bandit.readthedocs.io/en/latest/plugins/B602.html)", "MEDIUM"),
            ("jobs/nightly.py", 2, "call()", "bandit: Pickle read (https://bandit.readthedocs.io/en/latest/plugins/B301.html)", "LOW"),
        ],
    ),
    "brakeman": (
        {
            "warnings": [
                {"file": "app/cart.rb", "line": 52, "code": "eval(q)", "warning_type": "Evaluation", "message": "Query is run", "confidence": "Medium"},
                {"file": "app/user.rb", "line": 3, "code": "", "warning_type": "Redirect", "message": "Open target", "confidence": "Weak"},
            ]
        },
        [
            ("app/cart.rb", 52, "eval(q)", "brakeman: Evaluation - Query is run", "Medium"),
            ("app/user.rb", 3, "", "brakeman: Redirect - Open target", "Weak"),
        ],
    ),
    "njsscan": (
        {
            "errors": [],
            "web/pay.js": {"findings": [{"line": 14, "lines": "eval(a)", "title": "Text as code", "metadata": {}}]},
            "web/skipped.js": {"skipped": True},
        },
        [("web/pay.js", 14, "eval(a)", "njsscan: Text as code", "UNKNOWN")],
    ),
    "gosec": (
        {
            "Issues": [
                {"file": "cmd/sync.go", "line": "205", "code": "exec(c)", "details": "Command from input", "severity": "LOW"},
                {"file": "cmd/sync.go", "line": "9", "code": "md5(x)", "details": "Weak digest", "severity": "MEDIUM"},
            ]
        },
        [
            ("cmd/sync.go", 205, "exec(c)", "gosec: Command from input", "LOW"),
            ("cmd/sync.go", 9, "md5(x)", "gosec: Weak digest", "MEDIUM"),
        ],
    ),
    "cppcheck": (
        """<?xml version="1.0"?><results version="2"><errors>
        <error id="u" severity="warning" msg="Variable &apos;n&apos; is read before it is set"><location file="io/ring.cpp" line="77"/></error>
        <error id="l" severity="style" msg="Unused &lt;loop&gt;"><location file="io/ring.h" line="4"/><location file="io/b.h" line="6"/></error>
        </errors></results>""",
        [
            ("io/ring.cpp", 77, "", "cppcheck: Variable 'n' is read before it is set", "WARNING"),
            ("io/ring.h", 4, "", "cppcheck: Unused <loop>", "STYLE"),
        ],
    ),
    "gitleaks": (
        [
            {"File": "deploy/prod.env", "StartLine": 12, "Secret": "pw1", "Description": "Database login"},
            {"File": "deploy/prod.env", "StartLine": 13, "Secret": "pw2", "Description": "Mail login", "Severity": "LOW"},
        ],
        [
            ("deploy/prod.env", 12, "pw1", "Gitleaks: Database login", "HIGH"),
            ("deploy/prod.env", 13, "pw2", "Gitleaks: Mail login", "LOW"),
        ],
    ),
}


@pytest.mark.parametrize("tool", CASES)
def test_report_gives_its_findings(spark, tool):
    document, expected = CASES[tool]
    columns = ("file_path", "line_number", "code_snippet", "description", "severity")
    rows = [tuple(row[c] for c in columns) for row in findings(spark, tool, document)]
    assert sorted(rows) == sorted(expected)


def test_model_answers_below_the_threshold_are_dropped(spark):
    entry = {"file_path": "a", "line_number": 1, "code_snippet": "x", "description": "d"}
    document = {"vulnerabilities": [{**entry, "confidence": 0.7}, {**entry, "confidence": 0.69}, entry]}
    text = f"Sure:\n```json\n{json.dumps(document)}\n```"
    (row,) = findings(spark, "model", text)
    assert row["confidence_score"] == 0.7 and row["severity"] == "UNKNOWN"


def test_empty_broken_and_unknown_reports(spark):
    raw = spark.createDataFrame(
        [(1, "semgrep", "empty", '{"results": []}'), (2, "bandit", "broken", "<html>"), (3, "nope", "odd", "{}")],
        "scan_id bigint, tool string, path string, text string",
    )
    parsed = R.parse_reports(raw)
    assert R.reported_findings(parsed).count() == 0
    rejected = {row.report_path: row.reject_reason for row in R.rejected_reports(parsed).collect()}
    assert rejected == {"broken": "undecodable", "odd": "unknown tool"}


def test_misconfigurations(spark):
    text = '```json\n{"misconfigurations": [{"line_number": 4, "description": "open port"}]}\n```'
    (row,) = findings(spark, "misconfiguration", text)
    assert (row["file_path"], row["line_number"], row["severity"]) == ("r", 4, None)


@pytest.mark.parametrize(
    "text, expected",
    [
        (
            {
                "results": [
                    {
                        "package": {"name": "left-shift", "version": "4.2.9"},
                        "vulns": [{"id": "CVE-2031-77001", "summary": "S", "details": "D"}, {"id": "X"}],
                    }
                ]
            },
            [
                ("CVE-2031-77001", "left-shift", "4.2.9", "S", "D"),
                ("X", "left-shift", "4.2.9", "No summary available.", "No details available."),
            ],
        ),
        ({"results": []}, []),
        ("<html>", []),
    ],
)
def test_advisory_reports(spark, text, expected):
    text = text if isinstance(text, str) else json.dumps(text)
    rows = R.advisories(spark.createDataFrame([(text,)], "text string")).orderBy("advisory_id").collect()
    assert [tuple(row) for row in rows] == expected


def value(spark, fn, text):
    result = spark.createDataFrame([(text,)], "text string").select(fn(F.col("text")).alias("v")).first().v
    return tuple(result) if hasattr(result, "asDict") else result


@pytest.mark.parametrize(
    "fn, text, expected",
    [
        (
            Q.javascript,
            '{"summary":{"reports":[{"complexity":{"maintainability":71.5,"cyclomatic":4,"sloc":9}}]}}',
            (71.5, 4, 9),
        ),
        (Q.javascript, '{"summary":{"reports":[]}}', (0.0, 0, 0)),
        (
            Q.ruby,
            '{"analysed_modules":[{"rating":"b","lines_of_code":7,"methods":[{"complexity":1.5},{},{"complexity":2}]}]}',
            (80.0, 3.5, 7),
        ),
        (Q.ruby, '{"analysed_modules":[]}', (0.0, 0.0, 0)),
        (
            Q.rust,
            '{"metrics":{"cyclomatic":{"sum":3},"mi":{"mi_original":90.5}},"spaces":[{"metrics":{"loc":5,"lloc":4}}]}\n{}',
            (90.5, 3.0, 5, 4, 0),
        ),
        (Q.rust, '{"metrics":{"cyclomatic":{"sum":3}},"spaces":[]}', (0.0, 0.0, 0, 0, 0)),
        (Q.rust, '{"metrics":{"cyclomatic":{"sum":3}}}', (0.0, 3.0, 0, 0, 0)),
        (Q.go_complexity, "3 main f a.go:1:1\n12 main g\n 4 no\n", 15),
        (Q.go_complexity, "", 0),
        (Q.coverage_percent, '<coverage line-rate="0.5"><packages/></coverage>', 50.0),
        (Q.coverage_percent, "<coverage/>", 0.0),
        (Q.coverage_percent, "broken", 0.0),
        (Q.duplicated_lines, "Found a 12 line duplication\nFound a 3 line duplication", 15),
        (Q.lint_issues, '[{"a":1},{"b":2}]', 2),
        (Q.lint_issues, "", 0),
        (Q.lint_issues, "oops", 0),
        (Q.cohesion, '{"a":{"lcom4":2,"ic":1},"b":{"lcom4":4}}', (0.5, 3.0)),
        (Q.cohesion, "{}", (0.0, 0.0)),
    ],
)
def test_quality_outputs(spark, fn, text, expected):
    assert value(spark, fn, text) == expected
