"""Reports to stored findings: verdicts, source checks, snippets, appends, unions, outputs."""

import json
import random

from pyspark.sql import functions as F

from auditlake.operators import joins, maintenance
from auditlake.operators.segments import ordered_lists
from auditlake.plans import findings as L
from auditlake.plans import feed, ingest, quality, texts
from auditlake.schemas import EXPORT_COLUMNS, FINDINGS
from auditlake.sinks import store as sink
from auditlake.sources import store
import pytest

FILES = [
    (1, "a.py", "one\ntwo\nthree\nfour\nfive\n"),
    (1, "b.py", "single"),
    (1, "bad.bin", None),
    (2, "a.py", "other"),
    (2, "gone.py", "here"),
]


def files(spark):
    return spark.createDataFrame(FILES, "scan_id bigint, path string, content string")


def report(path, line, code="x", message="m"):
    return {
        "check_id": "rule",
        "path": path,
        "start": {"line": line},
        "extra": {"lines": code, "message": message, "severity": "ERROR"},
    }


def raw(spark, *results):
    text = json.dumps({"results": list(results)})
    return spark.createDataFrame([(1, "semgrep", "p", text)], "scan_id bigint, tool string, path string, text string")


def test_source_checks_reject_with_a_reason(spark):
    rows = raw(
        spark,
        report("/work/a.py", 5),
        report("a.py", 6),
        report("a.py", 0),
        report("b.py", 1),
        report("b.py", 2),
        report("gone.py", 1),
        report("bad.bin", 99),
        report(None, 3),
    )
    checked = ingest.ingest(rows, files(spark), root="/work").orderBy("position").collect()
    reasons = [row.reject_reason for row in checked]
    late, gone = "line out of bounds", "file not found"
    assert reasons == [None, late, None, None, late, gone, None, None]
    assert checked[0].file_path == "a.py"


def test_files_of_other_checkouts_do_not_count(spark):
    def of(scan, *results):
        text = json.dumps({"results": list(results)})
        return (scan, "semgrep", f"p{scan}", text)

    places = [report("a.py", 2, "requires login"), report("a.py", 1, "requires login"), report("gone.py", 1)]
    rows = spark.createDataFrame([of(1, *places), of(2, *places)], "scan_id bigint, tool string, path string, text string")
    twice = files(spark).unionByName(files(spark))
    got = {(r.scan_id, r.file_path, r.line_number): r for r in ingest.ingest(rows, twice).collect()}
    assert len(got) == 6
    reasons = {key: row.reject_reason for key, row in got.items()}
    assert reasons == {
        (1, "a.py", 2): None,
        (1, "a.py", 1): None,
        (1, "gone.py", 1): "file not found",
        (2, "a.py", 2): "line out of bounds",
        (2, "a.py", 1): None,
        (2, "gone.py", 1): None,
    }
    assert got[2, "a.py", 1].code_snippet == "other" and got[1, "a.py", 1].code_snippet.startswith("one\n")


def test_misconfigurations_are_not_checked_and_rejects_are_kept(spark):
    answer = "```json\n" + json.dumps({"misconfigurations": [{"line_number": 99, "description": "root"}]}) + "\n```"
    rows = spark.createDataFrame(
        [(1, "misconfiguration", "Dockerfile", answer), (1, "semgrep", "r1", "{"), (1, "bandit", "r2", "no")],
        "scan_id bigint, tool string, path string, text string",
    )
    findings, rejects = ingest.ingest_all(rows, files=files(spark))
    (row,) = findings.collect()
    assert (row.line_number, row.reject_reason) == (99, None)
    assert sorted(r.report_path for r in rejects.collect()) == ["r1", "r2"]


def test_verdicts_match_missing_snippets(spark):
    schema = "id string, description string, code_snippet string"
    rows = spark.createDataFrame([("1", "d", None), ("2", "d", "x"), ("3", "e", None)], schema)
    verdicts = spark.createDataFrame([("d", None, True)], "description string, code_snippet string, false_positive boolean")
    kept = joins.suppress(rows, verdicts, ["description", "code_snippet"])
    assert sorted(r.id for r in kept.collect()) == ["2", "3"]


def test_one_advisory_in_several_versions_is_linked(spark):
    findings = spark.createDataFrame([("1", "p", None), ("2", "q", None)], "id string, package string, cve_id string")
    advisories = spark.createDataFrame(
        [("p", "1", "A"), ("p", "2", "A"), ("p", "3", "A"), ("q", "1", "B"), ("q", "1", "C")],
        "package string, version string, advisory_id string",
    )
    assert {r.id: r.cve_id for r in joins.link_cves(findings, advisories).collect()} == {"1": "A", "2": None}


def test_the_newest_answer_about_a_finding_counts(spark):
    findings = spark.createDataFrame([("1", 0.1), ("2", 0.2)], "id string, confidence_score double")
    answers = spark.createDataFrame([("1", 1, "0.5"), ("1", 3, " 0.9\n"), ("1", 2, "no")], "id string, at int, answer string")
    scored = maintenance.merge_scores(findings, answers, "id", ["at"]).collect()
    assert {r.id: r.confidence_score for r in scored} == {"1": 0.9, "2": 0.2} and len(scored) == 2


def test_a_request_clears_its_flag_until_the_next_push(spark):
    schema = "id bigint, last_commit_hash string, needs_scan boolean"
    repositories = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, None, True), (4, "d", False)], schema)
    requests = feed.commit_scan_requests(repositories)
    after = feed.take_requests(repositories, requests)
    assert after.filter("needs_scan").count() == 0 and after.count() == 4
    pushed = spark.createDataFrame([(1, "a2", True), (2, "b", True), (3, None, True), (4, "d", False)], schema)
    assert [r.id for r in feed.take_requests(pushed, requests).filter("needs_scan").collect()] == [1]
    scans = spark.createDataFrame([(7,)], "id bigint")
    numbered = feed.with_scan_ids(requests, scans)
    assert numbered.collect() == numbered.collect() and all(r.id > 7 for r in numbered.collect())


def test_chains_of_renames_are_followed_to_their_end(spark):
    renames = [(1, f"f{i}", f"f{i + 1}") for i in range(9)] + [(1, "x", "y"), (1, "y", "x"), (1, "z", "x"), (2, "f0", "g")]
    table = spark.createDataFrame(renames, "repo int, old_file string, new_file string")
    commits = spark.createDataFrame(
        [(1, "f0"), (1, "f8"), (1, "f9"), (1, "x"), (1, "z"), (1, "other"), (2, "f0")], "repo int, file string"
    ).withColumn("commit_hash", F.monotonically_increasing_id())
    followed = quality.follow_renames(commits, table).groupBy("repo", "file").count().collect()
    assert {(r.repo, r.file): r["count"] for r in followed} == {
        (1, "f9"): 3,
        (1, "x"): 1,
        (1, "z"): 1,
        (1, "other"): 1,
        (2, "g"): 1,
    }


def test_withheld_snippets_come_from_the_file(spark):
    rows = raw(spark, *[report("a.py", n, "requires login") for n in (1, 3, 3)], report("b.py", 1, "kept"))
    filled = ingest.ingest(rows, files(spark)).orderBy("position").collect()
    snippets = [row.code_snippet for row in filled]
    assert snippets == ["one\ntwo\nthree\nfour\n", "one\ntwo\nthree\nfour\nfive\n", "one\ntwo\nthree\nfour\nfive\n", "kept"]


def test_positive_verdicts_drop_findings(spark):
    rows = raw(spark, report("a.py", 1, message="real"), report("a.py", 1, message="fake"), report("a.py", 1, message="new"))

    def text(message):
        return f"semgrep: {message} (https://semgrep.dev/r/rule)"

    verdicts = spark.createDataFrame(
        [(text("real"), "x", False), (text("fake"), "x", True), (text("new"), "x", None)],
        "description string, code_snippet string, false_positive boolean",
    )
    kept = ingest.ingest(rows, files(spark), verdicts).collect()
    assert sorted(row.description for row in kept) == [text("new"), text("real")]


def test_equal_entries_keep_ids_of_their_own_and_reruns_keep_ids(spark):
    rows = ingest.to_store(ingest.ingest(raw(spark, report("a.py", 1), report("a.py", 1))))
    first, second = ({row.id for row in rows.collect()} for _ in range(2))
    assert len(first) == 2 and first == second


def test_appends_are_idempotent_and_read_with_the_fixed_schema(spark, tmp_path):
    rows = ingest.to_store(ingest.ingest(raw(spark, report("a.py", 1), report("a.py", 2))))
    for batch in ("one", "one", "two"):
        sink.append_batch(rows.limit(2), str(tmp_path), "findings", batch)
    stored = sink.read_appended(spark, str(tmp_path), "findings")
    assert stored.schema == FINDINGS and stored.count() == 4
    assert {row.status for row in stored.collect()} == {"new"}


def test_snapshots_are_never_overwritten(spark, tmp_path):
    sink.write_snapshot(spark.range(1), str(tmp_path), "scan", 1)
    with pytest.raises(Exception, match="already exists"):
        sink.write_snapshot(spark.range(1), str(tmp_path), "scan", 1)


def test_json_export_has_all_fields_of_the_newest_scan(spark, tmp_path):
    findings = spark.createDataFrame(
        [("f1", 1, "old"), ("f2", 2, "d")], "id string, scan_id bigint, description string"
    )
    findings = ingest.to_store(findings)
    scans = spark.createDataFrame([(1, 7), (2, 7)], "id bigint, repository_id bigint")
    repositories = spark.createDataFrame([(7, "u")], "id bigint, url string")
    rows = sink.export_rows(findings, scans, repositories)
    sink.export_json(rows, str(tmp_path / "out"))
    (line,) = [x.value for x in spark.read.text(str(tmp_path / "out")).collect()]
    record = json.loads(line)
    assert list(record) == EXPORT_COLUMNS and record["id"] == "f2" and record["cve_id"] is None


def test_deep_scan_keeps_the_bag_but_advisories_once(spark):
    rules = spark.createDataFrame([(1, "d"), (1, "d")], "scan_id bigint, description string")
    advisory = spark.createDataFrame([(1, "s", "A"), (1, "s", "A")], "scan_id bigint, description string, cve_id string")
    union = joins.deep_scan_findings({"semgrep": rules, "advisory": advisory})
    assert {row.tool: row["count"] for row in union.groupBy("tool").count().collect()} == {"semgrep": 2, "advisory": 1}


def test_already_reported_findings_compare_null_safely(spark):
    schema = "scan_id bigint, file_path string, line_number int, description string"
    known = spark.createDataFrame([(1, None, None, "d"), (1, "a", 1, "d")], schema)
    fresh = spark.createDataFrame([(1, None, None, "d"), (1, "a", 2, "d"), (2, "a", 1, "d")], schema)
    kept = {tuple(row) for row in joins.unreported(fresh, known).collect()}
    assert kept == {(1, "a", 2, "d"), (2, "a", 1, "d")}


def test_cve_is_linked_only_when_unique(spark):
    schema = "id string, package string, cve_id string"
    findings = spark.createDataFrame([("1", "a", None), ("2", "b", None), ("3", None, None), ("4", "a", "X")], schema)
    advisories = spark.createDataFrame([("a", "A1"), ("b", "B1"), ("b", "B2")], "package string, advisory_id string")
    linked = {row.id: row.cve_id for row in joins.link_cves(findings, advisories).collect()}
    assert linked == {"1": "A1", "2": None, "3": None, "4": "X"}


def test_versionless_dependencies_match_by_package(spark):
    dependencies = spark.createDataFrame(
        [(1, "a", "1"), (1, "a", "1"), (2, "a", None), (3, "a", "9")], "scan_id bigint, package string, version string"
    )
    advisories = spark.createDataFrame(
        [("a", "1", "A1", "s"), ("a", "2", "A2", "s")],
        "package string, version string, advisory_id string, summary string",
    )
    matched = joins.match_advisories(dependencies, advisories)
    assert sorted((row.scan_id, row.advisory_id) for row in matched.collect()) == [(1, "A1"), (2, "A1"), (2, "A2")]


def test_large_groups_become_ordered_segments(spark):
    rng = random.Random(3)
    sizes = {"hot": 5000, "warm": 101, "small": 100, "one": 1}
    rows = [(key, i, f"{key}{i}") for key, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, text string").repartition(7)
    listed = ordered_lists(df, ["k"], ["n"], F.col("text"), limit=100).collect()
    for key, n in sizes.items():
        parts = sorted((row for row in listed if row.k == key), key=lambda row: row.segment)
        assert [x for row in parts for x in row["items"]] == [f"{key}{i}" for i in range(n)]
        assert all(len(row["items"]) <= 100 for row in parts)
        assert n > 100 or [row.segment for row in parts] == [0]


def test_transcript_lines(spark):
    messages = spark.createDataFrame(
        [(1, 2, "assistant", "b"), (1, 1, "user", "a")], "t bigint, ts bigint, sender string, message string"
    )
    (row,) = texts.transcripts(messages, ["t"], ["ts"]).collect()
    assert row.transcript == "user: a\nassistant: b"


def test_nested_report_pages_hold_everything(spark):
    n = 500
    findings = ingest.to_store(
        spark.createDataFrame([(f"f{i}", 1, f"d{i}") for i in range(n)], "id string, scan_id bigint, description string")
    )
    evidence = spark.createDataFrame([("f1", "t", "c")], "finding_id string, type string, content string")
    scans = spark.createDataFrame([(1, 7)], "id bigint, repository_id bigint")
    repositories = spark.createDataFrame([(7, "r")], "id bigint, name string")
    pages = texts.nested_report(findings, evidence, scans, repositories, page_size=50).collect()
    assert len(pages) == 10 and {row.finding_count for row in pages} == {n}
    listed = [f for row in pages for f in row.findings]
    assert sorted(f.id for f in listed) == sorted(f"f{i}" for i in range(n))
    assert [len(f.evidence) for f in listed if f.id == "f1"] == [1]


def test_nested_report_keeps_every_piece_of_evidence(spark):
    findings = ingest.to_store(
        spark.createDataFrame([(f"f{i}", 1, f"d{i}") for i in range(3)], "id string, scan_id bigint, description string")
    )
    rows = [("a", "f1", "test_output", "x"), ("b", "f1", "test_output", "w"), ("c", "f1", "root_cause_analysis", None)]
    rows += [("d", "f1", "test_output", "x"), ("e", None, "test_output", "x"), ("f", "f2", "patch", "p")]
    evidence = spark.createDataFrame(rows, "id string, finding_id string, type string, content string")
    scans = spark.createDataFrame([(1, 7)], "id bigint, repository_id bigint")
    repositories = spark.createDataFrame([(7, "r")], "id bigint, name string")
    pieces = [("root_cause_analysis", None), ("test_output", "w"), ("test_output", "x"), ("test_output", "x")]
    for table in (evidence, evidence.drop("id")):
        (row,) = texts.nested_report(findings, table, scans, repositories).collect()
        assert [(f.id, [tuple(e) for e in f.evidence]) for f in row.findings] == [("f0", []), ("f1", pieces), ("f2", [("patch", "p")])]
    parts = texts.nested_report(findings, evidence, scans, repositories, limit=3).orderBy("segment").collect()
    assert [(p.segment, p.finding_count, [f.id for f in p.findings]) for p in parts] == [(0, 3, ["f0", "f1", "f2"]), (1, 3, ["f1"])]
    assert [tuple(e) for p in parts for f in p.findings if f.id == "f1" for e in f.evidence] == pieces


def test_model_inputs_and_the_annotate_hook(spark):
    sources = spark.createDataFrame(
        [(1, "src/test_a.py", "x"), (1, "src/b.py", "y"), (1, "tests/c.py", "z"), (2, "src/b.py", "w"), (2, "src/d.py", " \n")],
        "scan_id bigint, path string, content string",
    )
    known = spark.createDataFrame(
        [("1", 1, "src/b.py", 2, "late"), ("2", 1, "src/b.py", 1, "early"), ("3", 1, None, 1, "none")],
        "id string, scan_id bigint, file_path string, line_number int, description string",
    )
    inputs = texts.model_inputs(sources, known)
    rows = {(row.scan_id, row.path): row for row in inputs.collect()}
    assert set(rows) == {(1, "src/test_a.py"), (1, "src/b.py"), (2, "src/b.py")}
    assert rows[1, "src/b.py"].existing_findings == "- **Line 1:** early\n- **Line 2:** late"
    assert rows[2, "src/b.py"].existing_findings == ""
    assert rows[1, "src/test_a.py"].is_test and not rows[1, "src/b.py"].is_test

    def stub(batches):
        for batch in batches:
            yield batch[["path"]].assign(answer="{}")

    assert texts.annotate(inputs, stub, "path string, answer string").count() == 3


def test_sorts(spark):
    rows = spark.createDataFrame(
        [("1", 1, "LOW", "b"), ("2", 1, "CRITICAL", "c"), ("3", 1, "odd", "a")],
        "id string, scan_id bigint, severity string, file_path string",
    )
    by = {order: [row.id for row in L.sort_findings(rows, "severity", order).collect()] for order in ("asc", "desc")}
    assert by == {"asc": ["2", "1", "3"], "desc": ["3", "1", "2"]}
    assert [row.id for row in L.sort_findings(rows, "file", "asc").collect()] == ["3", "1", "2"]
    assert [row.id for row in L.sort_metrics(rows, "no such column").collect()] == ["3", "1", "2"]


def test_cascade_and_threads(spark):
    tables = {
        "scan": spark.createDataFrame([(1,), (2,)], "id bigint"),
        "findings": spark.createDataFrame([("a", 1), ("b", 2)], "id string, scan_id bigint"),
        "evidence": spark.createDataFrame([("a",), ("b",)], "finding_id string"),
        "patch": spark.createDataFrame([("a",)], "finding_id string"),
        "quality_metric": spark.createDataFrame([(1,), (2,)], "scan_id bigint"),
    }
    left = maintenance.delete_scans(tables, spark.createDataFrame([(1,)], "scan_id bigint"))
    assert {name: df.count() for name, df in left.items()} == {
        "scan": 1,
        "findings": 1,
        "evidence": 1,
        "patch": 0,
        "quality_metric": 1,
    }
    messages = spark.createDataFrame(
        [("1", None, "m"), ("1", None, "n"), (None, "1", "q")],
        "finding_id string, quality_interpretation_id string, message string",
    )
    ids = spark.createDataFrame([("1",)], "id string")
    assert maintenance.delete_threads(messages, "finding", ids).collect()[0].message == "q"
    assert maintenance.delete_threads(messages, "quality", ids).count() == 2
    with pytest.raises(ValueError):
        maintenance.delete_threads(messages, "other", ids)


def test_file_inventory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x\n")
    (tmp_path / "Dockerfile").write_text("FROM y")
    rows = store.text_files(store.file_inventory(spark, str(tmp_path))).collect()
    assert {(row.path, row.repo, row.name, row.content) for row in rows} == {
        ("src/a.py", "src", "a.py", "x\n"),
        ("Dockerfile", None, "Dockerfile", "FROM y"),
    }


def test_report_files(spark, tmp_path):
    folder = tmp_path / "scan_id=4" / "tool=gosec"
    folder.mkdir(parents=True)
    (folder / "r.json").write_text('{"Issues": [\n{"file": "a.go", "line": "3"}]}')
    (row,) = ingest.to_store(ingest.ingest(store.report_files(spark, str(tmp_path)))).collect()
    assert (row.scan_id, row.file_path, row.line_number) == (4, "a.go", 3)


def test_marked_matches_are_deduplicated_without_comparing_them(spark):
    dependencies = spark.createDataFrame(
        [(1, "p", "1"), (1, "p", None), (1, "q", "1"), (2, "p", "1"), (2, "p", "2"), (3, "q", None), (3, "p", "1"), (None, "p", "1")],
        "scan_id long, package string, version string",
    )
    advisories = spark.createDataFrame(
        [("p", "1", "A", "a"), ("p", "1", "A", "a"), ("p", "2", "B", "b"), ("p", "1", "B", "b"), ("q", "1", "B", "b"), ("q", None, "C", None), ("p", "1", None, "n")],
        "package string, version string, advisory_id string, summary string",
    )
    plain = joins.advisory_findings(joins.match_advisories(dependencies, advisories))
    marked = joins.advisory_findings(joins.match_advisories(dependencies, advisories, told=True))
    rows = sorted(map(str, plain.collect()))
    assert sorted(map(str, marked.drop("once").collect())) == rows and len(rows) == len(set(rows))
    twice = joins.match_advisories(dependencies.union(dependencies), advisories, told=True)
    union = joins.deep_scan_findings({"advisory": joins.advisory_findings(twice)})
    assert sorted(map(str, union.drop("tool").collect())) == rows
    partly = marked.withColumn("once", F.col("cve_id") == "A").withColumn("k", F.explode(F.when(F.col("once"), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))).drop("k")
    assert sorted(map(str, joins.deep_scan_findings({"advisory": partly}).drop("tool").collect())) == rows


def test_advisories_of_a_package_meet_a_scan_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 3)
    advisories = spark.range(20).select(F.lit("p").alias("package"), F.lit("1").alias("version"), F.concat(F.lit("A"), "id").alias("advisory_id"), F.lit("s").alias("summary"))
    dependencies = spark.createDataFrame([(1, "p", None), (2, "p", None), (2, "q", None)], "scan_id long, package string, version string")
    matched = joins.match_advisories(dependencies, advisories)
    assert sorted((r.scan_id, r.advisory_id) for r in matched.collect()) == sorted((s, f"A{i}") for s in (1, 2) for i in range(20))
    tasks = matched.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1


def test_exports_leave_other_scans_out_where_findings_are_read(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(300).select(F.col("id").alias("scan_id"), F.concat(F.lit("p"), F.col("id") % 3).alias("k"), *[F.lit(None).cast("string").alias(c) for c in EXPORT_COLUMNS if c != "scan_id"]).write.parquet(path)
    names = spark.createDataFrame([(f"p{i}", i) for i in range(3)], "k string, n int")
    findings = spark.read.parquet(path).join(names, "k")
    scans = spark.range(300).select("id", (F.col("id") % 10).alias("repository_id"))
    repositories = spark.range(10).select("id", F.concat(F.lit("u"), "id").alias("url"))
    rows = sink.export_rows(findings, scans, repositories)
    assert sorted(r.scan_id for r in rows.collect()) == list(range(290, 300))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = next(i for i, line in enumerate(plan) if "getbit" in line)
    assert sum("Join" in line for line in plan[:below]) >= 2


def test_nested_report_moves_whole_findings_twice(spark):
    """Sizes of repositories come from counts by scan, and names meet pages where these are."""
    findings = [(f"f{i}", 1 + i % 2, "d", "p", i, "LOW", "new", 0.5, "x") for i in range(7)]
    table = spark.createDataFrame(findings, "id string, scan_id long, description string, file_path string, line_number int, severity string, status string, confidence_score double, code_snippet string")
    scans = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 2), (4, None)], "id long, repository_id long")
    repositories = spark.createDataFrame([(1, "r"), (1, "again"), (2, None)], "id long, name string")
    evidence = spark.createDataFrame([("f1", "log", "e"), (None, "log", "lost")], "finding_id string, type string, content string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = texts.nested_report(table, evidence, scans, repositories)
        rows = report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.repository_id, r.name, r.finding_count, len(r.findings)) for r in rows) == [(1, "again", 10, 10), (1, "r", 10, 10)]
    assert sorted(len(f.evidence) for f in rows[0].findings) == [0] * 8 + [1, 1]
    assert "Exchange" not in plan[: plan.index("collect_list")]


DEPENDENCY = "scan_id long, package string, version string"
ADVISORY = "package string, version string, advisory_id string, summary string, severity string"


def advisory_rows(seed):
    """Random dependencies and advisories with NULLs, repeated rows, and versions that look like numbers of lists."""
    rng = random.Random(seed)
    packages, versions = ["p", "q", "r", None], ["0", "1", "=1", "", None]
    dependencies = [(rng.choice([1, 2, 3, 4, None]), rng.choice(packages), rng.choice(versions)) for _ in range(40)]
    advisories = [(rng.choice(packages), rng.choice(versions), rng.choice(["A", "B", "C", "D", f"E{i}", None])) for i in range(60)]
    return dependencies, [(p, v, a, f"about {a}", "HIGH" if a and a > "B" else None) for p, v, a in advisories]


def pairs_of(dependencies, advisories):
    return {
        (scan, package, version, a[2], a[3], a[4])
        for scan, package, version in dependencies
        for a in advisories
        if package is not None and package == a[0] and (version is None or version == a[1])
    }


@pytest.mark.parametrize("size", [2, 1000])
def test_lists_of_advisories_give_every_match(spark, monkeypatch, size):
    monkeypatch.setattr(joins, "BLOCK", size)
    dependencies, advisories = advisory_rows(size)
    asked, known = spark.createDataFrame(dependencies, DEPENDENCY), spark.createDataFrame(advisories, ADVISORY)
    expected = pairs_of(dependencies, advisories)
    matched = joins.match_advisories(asked, known)
    assert matched.columns == ["package", "version", "scan_id", "advisory_id", "summary", "severity"]
    rows = [(r.scan_id, r.package, r.version, r.advisory_id, r.summary, r.severity) for r in matched.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    findings = joins.advisory_findings(joins.match_advisories(asked, known, told=True)).drop("once").collect()
    assert {(r.scan_id, r.cve_id, r.description, r.severity) for r in findings} == {(s, a, t, v) for s, _, _, a, t, v in expected}
    assert len(findings) == len({(s, a, t) for s, _, _, a, t, _ in expected})


def test_advisories_are_joined_by_the_list(spark):
    """A join has a row per scan, version and list; pairs come from the lists alone."""
    advisories = [("p", f"{i % 2}", f"A{i}", "s", None) for i in range(100)]
    dependencies = spark.createDataFrame([(1, "p", "0"), (2, "p", "1"), (3, "p", None)], DEPENDENCY)
    told = joins.match_advisories(dependencies, spark.createDataFrame(advisories, ADVISORY), told=True)
    assert sorted((r.scan_id, len(r.matched)) for r in told.collect()) == [(1, 50), (2, 50), (3, 100)]
    plan = joins.match_advisories(dependencies, spark.createDataFrame(advisories, ADVISORY))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and plan.index("Generate inline") < plan.index("Join")


@pytest.mark.parametrize("size", [2, 1000])
def test_findings_of_a_deep_scan_are_counted_in_their_lists(spark, monkeypatch, size):
    monkeypatch.setattr(joins, "BLOCK", size)
    dependencies, advisories = advisory_rows(size + 1)
    asked, known = spark.createDataFrame(dependencies, DEPENDENCY), spark.createDataFrame(advisories, ADVISORY)
    for table in (known, known.drop("severity"), known.withColumn("url", F.lit("u"))):
        told = joins.match_advisories(asked.union(asked), table, told=True)
        rules = spark.createDataFrame([(1, "s", "LOW")] * 3, "scan_id long, description string, severity string")
        rows = joins.deep_scan_findings({"rules": rules, "advisory": joins.advisory_findings(told)})
        lists = joins.deep_scan_findings({"rules": rules, "advisory": joins.advisory_findings(told, listed=True)})
        assert lists.count() < rows.count()
        single = {(r.tool, r.severity): r["count"] for r in rows.groupBy("tool", "severity").count().collect()}
        assert {(r.tool, r.severity): r.n for r in lists.groupBy("tool", "severity").agg(F.sum("n").alias("n")).collect()} == single
        unfolded = lists.filter("tool = 'advisory'").select("scan_id", "severity", F.inline("matched"))
        assert sorted((str(r.scan_id), str(r.advisory_id), str(r.summary), str(r.severity)) for r in unfolded.collect()) == sorted(
            (str(r.scan_id), str(r.cve_id), str(r.description), str(r.severity)) for r in rows.filter("tool = 'advisory'").collect()
        )
