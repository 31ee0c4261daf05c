"""Column functions on literal values."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions import lines, paths, severity, text


def one(spark, fn, *values, kinds=None):
    kinds = kinds or ["string"] * len(values)
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))
    row = spark.createDataFrame([values], schema)
    return row.select(fn(*[F.col(c) for c in row.columns]).alias("v")).first().v


@pytest.mark.parametrize(
    "raw, mapped",
    [
        ("CRITICAL", "CRITICAL"),
        ("High", "HIGH"),
        ("medium", "MEDIUM"),
        ("low", "LOW"),
        ("error", "HIGH"),
        ("warning", "MEDIUM"),
        ("info", "LOW"),
        ("unknown", "UNKNOWN"),
        ("Weak", "UNKNOWN"),
        (None, "UNKNOWN"),
    ],
)
def test_severity(spark, raw, mapped):
    assert one(spark, severity.map_severity, raw) == mapped


@pytest.mark.parametrize("value, rank", [("CRITICAL", 0), ("UNKNOWN", 4), ("else", 5), (None, 5)])
def test_severity_ordinal(spark, value, rank):
    assert one(spark, severity.severity_ordinal, value) == rank


@pytest.mark.parametrize(
    "path, language",
    [
        ("a/test.py", "Python"),
        ("test.js", "JavaScript"),
        ("test.rb", "Ruby"),
        ("test.go", "Go"),
        ("test.rs", "Rust"),
        ("test.c", "C"),
        ("test.cpp", "C++"),
        ("a/Gemfile", "Ruby"),
        ("Cargo.toml", "Rust"),
        ("x/package.json", "Node.js"),
        ("unknown.txt", None),
        ("a.PY", None),
        (".py", "Python"),
        ("dir.py/file", None),
        ("a.tar.sh", "Shell"),
        ("", None),
        (None, None),
    ],
)
def test_language(spark, path, language):
    assert one(spark, paths.language_of_path, path) == language


@pytest.mark.parametrize(
    "url, base, branch",
    [
        ("https://github.com/acme-co/till.app", "https://github.com/acme-co/till.app.git", None),
        ("https://github.com/acme-co/till.app.git", "https://github.com/acme-co/till.app.git", None),
        ("https://github.com/acme-co/till.app/tree/fix/rounding", "https://github.com/acme-co/till.app.git", "fix/rounding"),
        ("https://code.acme.example/till/app", None, None),
    ],
)
def test_urls(spark, url, base, branch):
    assert one(spark, text.clone_url, url) == base
    assert one(spark, text.url_branch, url) == branch


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://github.com/u/r", "https://github.com/u/r.git"),
        ("https://bitbucket.org/u/r", "https://bitbucket.org/u/r.git"),
        ("https://else.org/r.git", "https://else.org/r.git"),
        ("https://else.org/r", None),
    ],
)
def test_push_url(spark, url, expected):
    assert one(spark, text.push_url, url) == expected


def test_ref_listings(spark):
    listing = "5f0c\trefs/heads/trunk\n91be\trefs/heads/release/7"
    branches = one(spark, lambda c: F.transform(F.split(c, "\n"), text.branch_of_ref), listing)
    assert branches == ["trunk", "release/7"]
    assert one(spark, text.primary_branch, "ref: refs/heads/trunk\tHEAD\nh\tHEAD") == "trunk"
    assert one(spark, text.primary_branch, "h\tHEAD") is None
    assert one(spark, text.first_hash, "5f0c\trefs/heads/trunk") == "5f0c"
    assert one(spark, text.first_hash, "") is None


@pytest.mark.parametrize(
    "answer, expected",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('text\n```json\n{"a":\n 1}\n```\n```json\n{}\n```', '{"a":\n 1}'),
        ('  {"b": 2} ', '{"b": 2}'),
        ("nothing", "{}"),
    ],
)
def test_fenced_json(spark, answer, expected):
    assert one(spark, text.fenced_json, answer) == expected


@pytest.mark.parametrize(
    "description, expected",
    [
        ("semgrep: m (https://semgrep.dev/r/a.b)", ("semgrep: m", "https://semgrep.dev/r/a.b", "a.b")),
        (
            "bandit: m (https://bandit.readthedocs.io/en/latest/plugins/B001.html)",
            ("bandit: m", "https://bandit.readthedocs.io/en/latest/plugins/B001.html", "B001"),
        ),
        ("see https://x.org/y now", ("see https://x.org/y now", "https://x.org/y", "doc")),
        ("plain (text)", ("plain (text)", None, None)),
    ],
)
def test_description_parts(spark, description, expected):
    parts = (text.description_text, text.description_url, text.rule_id)
    assert tuple(one(spark, part, description) for part in parts) == expected


@pytest.mark.parametrize("log, passed", [("3 passed", True), ("1 FAILED", False), ("0 errors", False), ("", True)])
def test_log_verdict(spark, log, passed):
    assert one(spark, text.strict_log_verdict, log) is passed


def test_keyword_is_literal_and_case_blind(spark):
    assert one(spark, lambda c: text.has_keyword(c, "100%_Sure"), "is 100%_sure") is True
    assert one(spark, lambda c: text.has_keyword(c, "100%_Sure"), "is 100 is sure") is False
    assert one(spark, lambda c: text.from_scanner(c, "Semgrep"), "semgrep: x") is True
    assert one(spark, lambda c: text.from_scanner(c, "Semgrep"), "x semgrep: x") is False


@pytest.mark.parametrize(
    "path, source, with_tests, config",
    [
        ("src/a.py", True, True, False),
        ("tests/a.py", False, True, False),
        ("src/test/a.py", False, True, False),
        ("src/testing/a.py", True, True, False),
        ("a/node_modules/b/c.js", False, False, False),
        ("LICENSE", False, False, False),
        ("README.md", False, False, False),
        ("conf/values.yaml", True, True, True),
        ("a.yml", False, False, True),
        ("Dockerfile", True, True, True),
        ("main.tf", True, True, True),
    ],
)
def test_file_selection(spark, path, source, with_tests, config):
    assert one(spark, paths.is_source_file, path) is source
    assert one(spark, lambda c: paths.is_source_file(c, True), path) is with_tests
    assert one(spark, paths.is_config_file, path) is config


@pytest.mark.parametrize(
    "path, root, expected",
    [("/r/a.py", "/r", "a.py"), ("/r/a.py", "/r/", "a.py"), ("/rx/a.py", "/r", "/rx/a.py"), ("a.py", "/r", "a.py")],
)
def test_relative_path(spark, path, root, expected):
    assert one(spark, lambda c: paths.relative_path(c, root), path) == expected


@pytest.mark.parametrize("content", ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n", "\n\n", "a\rb", "a\n\nb\n"])
def test_line_arithmetic(spark, tmp_path, content):
    file = tmp_path / "f"
    file.write_bytes(content.encode())
    expected = open(file).readlines()
    assert one(spark, lines.line_count, content) == len(expected)
    assert one(spark, lines.split_lines, content) == [line.rstrip("\n") for line in expected]
    for n in range(0, 6):
        around = one(spark, lambda c: lines.around_line(F.split(c, lines.NEWLINE, -1), F.lit(n)), content)
        assert around == "".join(expected[max(0, n - 4) : min(len(expected), n + 3)])


def test_stripping_a_long_padded_text_is_linear(spark):
    import time

    from auditlake.functions.text import strip

    df = spark.sql("SELECT concat('  x', repeat(' ', 1000000), 'y \\n') AS t")
    start = time.perf_counter()
    assert df.select(F.length(strip(F.col("t")))).first()[0] == 1000002
    assert time.perf_counter() - start < 5


def test_anchored_rules_hit_inside_a_file(spark):
    from auditlake.operators.rules import Rule, rule_scan, secret_scan

    df = spark.createDataFrame([("a", "Python", "import os\npassword = 1\nx")], "path string, language string, content string")
    hits = rule_scan(df, [Rule("p", "^password", "E", "m"), Rule("o", "os$", "E", "m")]).collect()
    assert sorted((h.rule_id, h.line_number) for h in hits) == [("o", 1), ("p", 2)]
    digits = spark.createDataFrame([("a", "x", "1" * 40 + " " + "2" * 16)], "path string, language string, content string")
    plain, salted = (secret_scan(digits, salt=s).collect() for s in ("", "pepper"))
    assert [h.rule_id for h in plain] == ["card-number"] and plain[0].fingerprint != salted[0].fingerprint
