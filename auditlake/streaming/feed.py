"""Structured Streaming forms of the change feed.

Every query keeps its checkpoint and its output below one root in the shared
folder. Plain sinks are exactly-once file sinks; batch-wise ones write batch k to
a folder named after k from inputs older than k, so a replayed batch rewrites the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.paths import base_name
from auditlake.plans import feed, ingest

STATE = "url string, commit_hash string, ts timestamp, event_id bigint, needs_scan boolean"
REPOSITORY_ROW = "url string, name string"
RAW_REPORT = "scan_id bigint, tool string, path string, text string"


def run_files(stream: DataFrame, root: str, partition_by: list[str] | None = None, available_now: bool = True):
    """Append a stream to parquet files below ``root``; returns the running or finished query."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/table")
    return _start(writer, available_now)


def run_batches(
    stream: DataFrame, root: str, handle: Callable[[DataFrame, int], None], mode: str = "append", available_now: bool = True
):
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle)
    return _start(writer.option("checkpointLocation", f"{root}/checkpoint"), available_now)


def _start(writer, available_now: bool):
    if not available_now:
        return writer.start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def intake(events: DataFrame, root: str, available_now: bool = True):
    """Push intake: one pass sorts events into folders by outcome, rejects included."""
    return run_files(feed.classify_pushes(events), root, ["outcome"], available_now)


def register_repositories(pushes: DataFrame, known: DataFrame, root: str, available_now: bool = True):
    """First-seen repositories; batch k looks at ``known`` and at what earlier batches added."""
    spark = known.sparkSession
    table = f"{root}/table"
    spark.createDataFrame([], REPOSITORY_ROW).write.mode("overwrite").parquet(f"{table}/batch=-1")

    def handle(batch: DataFrame, k: int) -> None:
        session = batch.sparkSession
        added = session.read.schema(f"{REPOSITORY_ROW}, batch bigint").parquet(table).filter(F.col("batch") < k)
        rows = feed.first_seen(batch, known.select("url").unionByName(added.select("url")))
        rows.select("url", "name").write.mode("overwrite").parquet(f"{table}/batch={k}")

    return run_batches(pushes, root, handle, available_now=available_now)


def registered(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(REPOSITORY_ROW).parquet(f"{root}/table").select("url", "name")


def track_commits(pushes: DataFrame, root: str, available_now: bool = True):
    """Latest hash per repository as versions of a narrow state table.

    Batch k reads version k-1 and writes version k, so replays are harmless. Each
    batch is reduced to one row per repository before it meets the state.
    """
    spark = pushes.sparkSession
    table = f"{root}/state"
    spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{table}/version=-1")

    def handle(batch: DataFrame, k: int) -> None:
        session = batch.sparkSession
        state = session.read.schema(STATE).parquet(f"{table}/version={k - 1}")
        feed.advance_state(state, batch).write.mode("overwrite").parquet(f"{table}/version={k}")

    return run_batches(pushes, root, handle, available_now=available_now)


def commit_state(spark: SparkSession, root: str) -> DataFrame:
    """State after the last batch that the query committed, whoever ran it.

    Older versions are not read; they may be removed once a newer one is committed.
    """
    return spark.read.schema(STATE).parquet(f"{root}/state/version={last_batch(spark, root)}")


def last_batch(spark: SparkSession, root: str) -> int:
    """Highest batch in the checkpoint's commit log, -1 before the first one."""
    log = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*")
    try:
        batches = log.load(f"{root}/checkpoint/commits").select(base_name(F.col("path")).cast("bigint").alias("k"))
    except AnalysisException:
        return -1
    highest = batches.agg(F.max("k")).first()[0]
    return -1 if highest is None else highest


def ingest_reports(reports: DataFrame, root: str, available_now: bool = True):
    """Raw reports as they arrive -> ``table`` of findings and ``rejects``, one folder a batch.

    A batch is parsed once and written to both. Finding ids come from the report's
    place, so a batch that runs again replaces its folders by the same rows.
    """

    def handle(batch: DataFrame, k: int) -> None:
        findings, rejects = ingest.ingest_all(batch)
        ingest.to_store(findings).write.mode("overwrite").parquet(f"{root}/table/batch={k}")
        rejects.write.mode("overwrite").parquet(f"{root}/rejects/batch={k}")

    return run_batches(reports, root, handle, available_now=available_now)


def report_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Stream over a growing table of raw reports."""
    return spark.readStream.schema(RAW_REPORT).options(**options).parquet(path)


def report_file_stream(spark: SparkSession, root: str) -> DataFrame:
    """Stream over report files laid out as ``scan_id=<id>/tool=<tool>/<file>``."""
    return (
        spark.readStream.schema("text string, scan_id bigint, tool string")
        .text(root, wholetext=True)
        .select("scan_id", "tool", F.col("_metadata.file_path").alias("path"), "text")
    )


def roll_up_progress(units: DataFrame, root: str, available_now: bool = True):
    """Running counts per scan; each batch stores the counts it changed."""

    def handle(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={k}")

    return run_batches(feed.units_done(units), root, handle, "update", available_now)


def rolled_up(spark: SparkSession, root: str) -> DataFrame:
    """Counts only grow, so a scan's highest one is its present one."""
    rows = spark.read.parquet(f"{root}/table")
    return rows.groupBy("scan_id").agg(F.max("progress").alias("progress"))
