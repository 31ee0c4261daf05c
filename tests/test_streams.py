"""Streams read in several batches, restarted and out of order equal the batch result."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake.plans import feed as P
from auditlake.plans import ingest
from auditlake.sources import store
from auditlake.streaming import feed as S

EVENTS = "event_id bigint, ts timestamp, event_type string, body string"


def event(i, minute, url="u/a", after=None, kind="push"):
    body = {"repository": {"clone_url": url, "full_name": url.upper()}, "after": after or f"h{i}"}
    return (i, f"2024-01-01 00:{minute:02d}:00", kind, json.dumps(body))


ROUNDS = [
    [event(1, 5), event(2, 1), event(3, 2, "u/b"), event(4, 3, kind="ping")],
    [event(5, 3), event(6, 4, "u/b", "h3"), event(7, 9, "u/c"), (8, "2024-01-01 00:01:00", "push", "{}")],
    [event(7, 9, "u/c"), event(9, 8, "u/c", "0" * 40)],
]


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "events")
    for rows in ROUNDS:
        df = spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, body string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def batch(spark, folder):
    return spark.read.schema(EVENTS).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_intake_sorts_by_outcome(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    S.intake(stream(spark, folder), root)
    S.intake(stream(spark, folder), root)
    got = spark.read.parquet(f"{root}/table")
    expected = P.classify_pushes(batch(spark, folder))
    assert rows(got.select(expected.columns)) == rows(expected)
    outcomes = {row.outcome: row["count"] for row in got.groupBy("outcome").count().collect()}
    assert outcomes == {"accepted": 7, "not a push": 1, "invalid payload": 1, "branch deleted": 1}


def test_commit_state_does_not_depend_on_batches(spark, folder, tmp_path):
    pushes = P.accepted_pushes(P.classify_pushes(stream(spark, folder)))
    root = str(tmp_path / "out")
    assert S.last_batch(spark, root) == -1
    S.track_commits(pushes, root)
    S.track_commits(pushes, root)
    assert S.last_batch(spark, root) == len(ROUNDS) - 1
    state = S.commit_state(spark, root)
    empty = spark.createDataFrame([], S.STATE)
    at_once = P.advance_state(empty, P.accepted_pushes(P.classify_pushes(batch(spark, folder))))
    assert rows(state) == rows(at_once)
    assert {row.url: row.commit_hash for row in state.collect()} == {"u/a": "h1", "u/b": "h3", "u/c": "h7"}


def test_restarted_tracking_goes_on_from_its_state(spark, folder, tmp_path):
    pushes = P.accepted_pushes(P.classify_pushes(stream(spark, folder)))
    root = str(tmp_path / "out")
    S.track_commits(pushes, root)
    late = spark.createDataFrame([event(10, 30, "u/b")], "event_id bigint, ts string, event_type string, body string")
    late.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(folder)
    S.track_commits(pushes, root)
    assert {row.url: row.commit_hash for row in S.commit_state(spark, root).collect()} == {
        "u/a": "h1",
        "u/b": "h10",
        "u/c": "h7",
    }


def test_replayed_and_unchanged_pushes_request_no_scan(spark):
    state = spark.createDataFrame(
        [("u/a", "h1", None, 1, False), ("u/b", "old", None, 1, False)], S.STATE
    ).withColumn("ts", F.timestamp_seconds(F.lit(0)))
    schema = "event_id bigint, url string, full_name string, commit_hash string"
    pushes = spark.createDataFrame([(1, "u/a", "a", "h1"), (2, "u/b", "b", "new"), (3, "u/c", "c", "x")], schema)
    moved = P.advance_state(state, pushes.withColumn("ts", F.timestamp_seconds(F.col("event_id") - 1)))
    assert {row.url: row.needs_scan for row in moved.collect()} == {"u/a": False, "u/b": True, "u/c": True}


def test_first_seen_repositories_are_registered_once(spark, folder, tmp_path):
    pushes = P.accepted_pushes(P.classify_pushes(stream(spark, folder)))
    known = spark.createDataFrame([("u/b",)], "url string")
    root = str(tmp_path / "out")
    S.register_repositories(pushes, known, root)
    assert rows(S.registered(spark, root)) == [("u/a", "U/A"), ("u/c", "U/C")]


def test_progress_counts_over_batches(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    S.roll_up_progress(stream(spark, folder).select((F.col("event_id") % 2).alias("scan_id")), root)
    assert rows(S.rolled_up(spark, root)) == rows(
        P.units_done(batch(spark, folder).select((F.col("event_id") % 2).alias("scan_id")))
    )


def test_report_files_as_a_stream_equal_the_batch(spark, tmp_path):
    root, out = tmp_path / "reports", str(tmp_path / "out")

    def add(scan, name, line):
        folder = root / f"scan_id={scan}" / "tool=gosec"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps({"Issues": [{"file": "a.go", "line": str(line), "severity": "LOW"}]}, indent=2))

    add(1, "a.json", 1)
    S.ingest_reports(S.report_file_stream(spark, str(root)), out)
    add(1, "b.json", 2)
    add(2, "a.json", 3)
    S.ingest_reports(S.report_file_stream(spark, str(root)), out)
    S.ingest_reports(S.report_file_stream(spark, str(root)), out)
    at_once = ingest.to_store(ingest.ingest(store.report_files(spark, str(root))))
    streamed = spark.read.parquet(f"{out}/table")
    assert streamed.count() == 3
    assert rows(streamed.select("scan_id", "line_number", "severity")) == rows(
        at_once.select("scan_id", "line_number", "severity")
    )


def test_polls_see_changes_only(spark):
    schema = "event_id bigint, url string, commit_hash string, minute int"
    pushes = spark.createDataFrame(
        [(1, "u", "a", 0), (2, "u", "b", 1), (3, "u", "b", 6), (4, "u", None, 7), (5, "u", "c", 11)], schema
    ).withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))
    changes = P.new_commits_by_poll(pushes).orderBy("polled_at").collect()
    assert [(row.commit_hash, row.previous_hash) for row in changes] == [("b", None), ("c", "b")]


def test_stored_hash_changes_only_with_a_new_one(spark):
    repositories = spark.createDataFrame(
        [("u1", "old_hash", False), ("u2", "same", False), ("u3", "kept", True), ("u4", None, None)],
        "url string, last_commit_hash string, needs_scan boolean",
    )
    refs = spark.createDataFrame([("u1", "new_hash"), ("u2", "same"), ("u3", None), ("u4", "first")], "url string, commit_hash string")
    after = {row.url: (row.last_commit_hash, row.needs_scan) for row in P.detect_new_commits(repositories, refs).collect()}
    assert after == {"u1": ("new_hash", True), "u2": ("same", False), "u3": ("kept", True), "u4": ("first", True)}


def test_a_url_listed_twice_takes_its_primary_branch_then_the_newest(spark):
    repositories = spark.createDataFrame([("u1", "main", "old", False), ("u2", "dev", "old", False)], "url string, primary_branch string, last_commit_hash string, needs_scan boolean")
    refs = [("u1", "main", "a", 1), ("u1", "main", "b", 0), ("u1", "zzz", "z", 9), ("u2", "main", "y", 5), ("u2", "dev", None, 9)]
    table = spark.createDataFrame(refs, "url string, branch string, commit_hash string, ts int")
    after = {r.url: (r.last_commit_hash, r.needs_scan) for r in P.detect_new_commits(repositories, table).collect()}
    assert after == {"u1": ("a", True), "u2": ("old", False)}
    newest = {r.url: r.last_commit_hash for r in P.detect_new_commits(repositories, table.drop("branch")).collect()}
    assert newest == {"u1": "z", "u2": "y"}
