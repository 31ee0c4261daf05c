"""Streams whose state is one row a key in Spark's state store.

A batch touches the keys that have events in it and no others: their rows are
updated in place, and what changed is written to a folder named after the batch.
The state itself is read from the checkpoint, so no table of it is kept. Ordering
and arithmetic of one key's events are all that runs in Python.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.streaming.feed import last_batch, run_batches

COMMIT_STATE = "commit_hash string, ts bigint, event_id bigint, since bigint, needs_scan boolean"
PROGRESS_STATE = "progress bigint, total_progress bigint"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


def commit_events(pushes: DataFrame, requests: DataFrame) -> DataFrame:
    """Pushes (url, commit_hash, ts, event_id) and taken requests (url, commit_hash, ts) as one stream of events."""
    columns = ["url", "commit_hash", "ts", "event_id", "request"]
    taken = requests.withColumns({"event_id": F.lit(None).cast("bigint"), "request": F.lit(True)})
    return pushes.withColumn("request", F.lit(False)).select(columns).unionByName(taken.select(columns))


def follow(state: tuple | None, events: list[tuple]) -> tuple | None:
    """The state (hash, ts, event id, since, needs_scan) of a repository after some events (ts, request, event id, hash).

    A push no newer than the last one changes nothing, so replays are harmless. A
    push of another hash sets ``needs_scan``; one of the same hash leaves it. A
    request clears it if it names the present hash and was taken after that hash
    came, so neither a request that a push overtook nor one read twice clears it.
    """
    for ts, request, event_id, commit in sorted(events, key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2])):
        if request:
            if state and state[0] == commit and ts >= state[3]:
                state = (*state[:4], False)
        elif state is None or (ts, event_id) > state[1:3]:
            changed = state is None or state[0] != commit
            state = (commit, ts, event_id, ts, True) if changed else (commit, ts, event_id, *state[3:])
    return state


def _follow_key(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    before = tuple(state.get) if state.exists else None
    events = [
        (int(ts), bool(request), None if pd.isna(event_id) else int(event_id), commit)
        for frame in frames
        for ts, request, event_id, commit in zip(frame["ts"], frame["request"], frame["event_id"], frame["commit_hash"])
    ]
    after = follow(before, events)
    if after != before:
        state.update(after)
        yield pd.DataFrame([(key[0], *after)], columns=["url", "commit_hash", "ts", "event_id", "since", "needs_scan"])


def follow_commits(events: DataFrame, root: str, available_now: bool = True):
    """The newest hash of each repository and whether it waits for a scan, kept by url.

    ``events`` as of ``commit_events``; a request follows the push it is for, as it
    is made from the state that the push left. Events without url, hash or time
    say nothing. ``root/changes/batch=k`` holds the rows that batch k changed.
    """
    known = events.filter("url IS NOT NULL AND commit_hash IS NOT NULL AND ts IS NOT NULL")
    changes = (
        known.withColumns({"ts": F.unix_micros("ts"), "event_id": F.when(~F.col("request"), F.coalesce("event_id", F.lit(-1)))})
        .groupBy("url")
        .applyInPandasWithState(_follow_key, f"url string, {COMMIT_STATE}", COMMIT_STATE, "update", "NoTimeout")
    )

    def handle(batch: DataFrame, k: int) -> None:
        _dated(batch).write.mode("overwrite").parquet(f"{root}/changes/batch={k}")

    return run_batches(changes, root, handle, "update", available_now)


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"ts": F.timestamp_micros("ts"), "since": F.timestamp_micros("since")})


def _stored(spark: SparkSession, root: str, key: str, schema: str) -> DataFrame:
    if last_batch(spark, root) < 0:
        return spark.createDataFrame([], f"{key}, {schema}")
    rows = spark.read.format("statestore").load(f"{root}/checkpoint")
    return rows.select("key.*", "value.groupState.*")


def followed_commits(spark: SparkSession, root: str) -> DataFrame:
    """(url, commit_hash, ts, event_id, since, needs_scan) as the last batch left them."""
    return _dated(_stored(spark, root, "url string", COMMIT_STATE))


def requests_of(states: DataFrame, now) -> DataFrame:
    """A taken request for every repository that waits for a scan; feed it back to clear the flags."""
    return states.filter("needs_scan").select("url", "commit_hash", now.alias("ts"))


def _count_units(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    columns = ["scan_id", "progress", "total_progress", "finished"]
    if state.hasTimedOut:
        progress, total = state.get
        state.remove()
        yield pd.DataFrame([(key[0], progress, total, False)], columns=columns)
        return
    progress, total = state.get if state.exists else (0, 0)
    latest = 0
    for frame in frames:
        progress += len(frame)
        total = max(total, int(frame["total_progress"].max()))
        latest = max(latest, int(frame["at"].max()))
    finished = 0 < total <= progress
    if finished:
        progress = total
        if state.exists:
            state.remove()
    else:
        state.update((progress, total))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + int(frame["idle"].iloc[0]))
    yield pd.DataFrame([(key[0], progress, total, finished)], columns=columns)


def count_units(units: DataFrame, root: str, late: str = "1 hour", idle_ms: int = 86_400_000, available_now: bool = True):
    """Units done per open scan, kept until the scan is finished.

    ``units``: (scan_id, total_progress, ts), one row a unit of work. A scan with all
    its units done leaves the state with its last row, ``finished``; one without any
    unit for ``idle_ms`` of event time leaves it unfinished. Units beyond the total
    count for nothing. ``root/table/batch=k`` holds the rows that batch k changed.
    """
    known = units.filter("scan_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    total = F.coalesce(F.col("total_progress").cast("bigint"), F.lit(0).cast("bigint"))
    rows = known.select("scan_id", "ts", total.alias("total_progress"), F.unix_millis("ts").alias("at"), F.lit(idle_ms).cast("bigint").alias("idle"))
    counted = rows.groupBy("scan_id").applyInPandasWithState(
        _count_units, f"scan_id bigint, {PROGRESS_STATE}, finished boolean", PROGRESS_STATE, "update", "EventTimeTimeout"
    )

    def handle(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={k}")

    return run_batches(counted, root, handle, "update", available_now)


def open_scans(spark: SparkSession, root: str) -> DataFrame:
    """(scan_id, progress, total_progress) of the scans still in the state."""
    return _stored(spark, root, "scan_id bigint", PROGRESS_STATE).select("scan_id", "progress", "total_progress")


def counted_units(spark: SparkSession, root: str) -> DataFrame:
    """(scan_id, progress, finished): counts only grow, and a finished scan stays finished."""
    rows = spark.read.parquet(f"{root}/table")
    return rows.groupBy("scan_id").agg(F.max("progress").alias("progress"), F.bool_or("finished").alias("finished"))
