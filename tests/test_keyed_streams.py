"""Keyed stream state over several batches, replays and restarts."""

import random

from pyspark.sql import functions as F

from auditlake.streaming import feed as S
from auditlake.streaming import keyed as K

EVENT = "url string, commit_hash string, ts timestamp, event_id bigint, request boolean"
UNIT = "scan_id bigint, total_progress int, ts timestamp"


def append(spark, rows, schema, path):
    plain = schema.replace("ts timestamp", "ts bigint")
    table = spark.createDataFrame(rows, plain).withColumn("ts", F.timestamp_seconds("ts"))
    table.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def push(url, commit, ts, event_id):
    return (url, commit, ts, event_id, False)


def request(url, commit, ts):
    return (url, commit, ts, None, True)


def states(spark, root):
    return {r.url: (r.commit_hash, r.needs_scan) for r in K.followed_commits(spark, root).collect()}


def changed(spark, root, k):
    return {r.url for r in spark.read.parquet(f"{root}/changes/batch={k}").collect()}


def test_push_request_replay_push_over_batches_and_a_restart(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    assert K.followed_commits(spark, root).count() == 0
    append(spark, [push("a", "h1", 1, 1), push("b", "h2", 1, 2), push(None, "x", 1, 3), push("c", None, 1, 4)], EVENT, path)
    events = stream(spark, path, EVENT)
    K.follow_commits(events, root)
    assert states(spark, root) == {"a": ("h1", True), "b": ("h2", True)}
    append(spark, [request("a", "h1", 2)], EVENT, path)
    append(spark, [push("a", "h1", 1, 1), push("a", "h0", 0, 9)], EVENT, path)  # a replay and an older push
    K.follow_commits(events, root)  # a restart from the checkpoint
    assert states(spark, root) == {"a": ("h1", False), "b": ("h2", True)}
    assert changed(spark, root, 1) == {"a"} and changed(spark, root, 2) == set()
    append(spark, [push("a", "h1", 3, 10)], EVENT, path)  # the same hash again
    append(spark, [push("a", "h3", 4, 11)], EVENT, path)
    append(spark, [request("a", "h1", 5), request("b", "h2", 0)], EVENT, path)  # overtaken, and older than the push
    K.follow_commits(events, root)
    assert states(spark, root) == {"a": ("h3", True), "b": ("h2", True)}
    assert [changed(spark, root, k) for k in (3, 4, 5)] == [{"a"}, {"a"}, set()]
    waiting = K.requests_of(K.followed_commits(spark, root), F.timestamp_seconds(F.lit(9)))
    assert {r.url for r in waiting.collect()} == {"a", "b"}


def test_following_in_any_batches_equals_following_in_order():
    rng = random.Random(41)
    for _ in range(200):
        events = [(t, rng.random() < 0.4, None, rng.choice("xyz")) for t in range(20)]
        events = [(t, r, None if r else t, h) for t, r, _, h in events]
        state = None
        for t, taken, event_id, commit in events:
            if taken:
                state = (*state[:4], False) if state and state[0] == commit else state
            else:
                state = (commit, t, event_id, t, True) if not state or state[0] != commit else (commit, t, event_id, *state[3:])
        cut = sorted(rng.sample(range(20), 3))
        batched = None
        for a, b in zip([0, *cut], [*cut, 20]):
            part = events[a:b]
            rng.shuffle(part)
            batched = K.follow(batched, part)
            batched = K.follow(batched, part)  # read twice
        assert batched == state


def test_finished_scans_leave_the_state(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    rng, done, total = random.Random(42), {}, {s: 1 + s % 5 for s in range(12)}
    total[11] = 0  # no total: open until idle
    for k in range(10):
        rows = []
        for scan in range(12):
            if done.get(scan, 0) < (total[scan] or 99) and rng.random() < 0.3:
                done[scan] = done.get(scan, 0) + 1
                rows.append((scan, total[scan] or None, 1000 + k))
        append(spark, rows or [(None, 1, 1000)], UNIT, path)
    units = stream(spark, path, UNIT)
    K.count_units(units, root)
    is_open = {s: n for s, n in done.items() if not total[s] or n < total[s]}
    assert S.last_batch(spark, root) >= 9
    assert {r.scan_id: r.progress for r in K.open_scans(spark, root).collect()} == is_open
    rows = {r.scan_id: (r.progress, r.finished) for r in K.counted_units(spark, root).collect()}
    assert rows == {s: (n, s not in is_open) for s, n in done.items()}
    append(spark, [(50, 9, 1000 + 90_000), (50, 9, 1000 + 200_000)], UNIT, path)  # event time moves on by days
    append(spark, [(51, 9, 1000 + 200_001)], UNIT, path)
    K.count_units(units, root)
    assert {r.scan_id for r in K.open_scans(spark, root).collect()} == {50, 51}
