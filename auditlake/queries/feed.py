"""Registered queries: change feed in batch and as streams, table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import maintenance as M
from auditlake.plans import feed as P
from auditlake.session import shared_path
from auditlake.sources.adapters import Host
from auditlake.streaming import feed as S
from auditlake.streaming import keyed as K

_NOW = "2000-01-01 00:00:00"
_STAMP = "yyyy-MM-dd HH:mm:ss"


def _pushes(host: Host) -> DataFrame:
    return P.accepted_pushes(P.classify_pushes(host.webhook_events(host.table("events"))))


def _push_stream(host: Host) -> DataFrame:
    return P.accepted_pushes(P.classify_pushes(host.webhook_events(host.event_stream())))


def push_intake(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return P.classify_pushes(host.webhook_events(host.table("events"))).drop("ts")


def push_intake_stream(spark: SparkSession, folder: str) -> DataFrame:
    host, root = Host(spark, folder), shared_path(spark, "intake")
    S.intake(host.webhook_events(host.event_stream()), root)
    return spark.read.parquet(f"{root}/table").drop("ts")


def first_seen_repositories(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return P.first_seen(_pushes(host), host.known_urls())


def first_seen_repositories_stream(spark: SparkSession, folder: str) -> DataFrame:
    host, root = Host(spark, folder), shared_path(spark, "registry")
    S.register_repositories(_push_stream(host), host.known_urls(), root)
    return S.registered(spark, root)


def new_commits_by_poll(spark: SparkSession, folder: str) -> DataFrame:
    pushes = _pushes(Host(spark, folder)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    seen = P.new_commits_by_poll(pushes, "6 hours")
    return seen.withColumn("polled_at", F.date_format("polled_at", _STAMP))


def new_commits(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories after polling the newest commit of each: customers play the stored side."""
    host = Host(spark, folder)
    stored = host.repositories().withColumn(
        "url", F.concat(F.lit("https://github.com/u/r"), "id", F.lit(".git"))
    )
    updated = P.detect_new_commits(stored, P.latest_push(_pushes(host)))
    return updated.select("id", "last_commit_hash", "needs_scan")


def commit_state_stream(spark: SparkSession, folder: str) -> DataFrame:
    host, root = Host(spark, folder), shared_path(spark, "commits")
    S.track_commits(_push_stream(host), root)
    return S.commit_state(spark, root).select("url", "commit_hash", "event_id", "needs_scan")


def commit_state_with_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The state that pushes and taken requests leave, read as three batches in the order of time."""
    host, root = Host(spark, folder), shared_path(spark, "followed")
    events = host.table("events")
    pushes = _pushes(host)
    rounds = K.commit_events(pushes, Host.taken_requests(events, pushes))
    first, last = pushes.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = F.floor((F.unix_micros("ts") - F.lit(first)) * 3 / F.lit(max(1, (last or 0) - (first or 0))))
    for k in range(3):
        rounds.filter(F.least(F.greatest(third, F.lit(0)), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    K.follow_commits(spark.readStream.schema(rounds.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root)
    return K.followed_commits(spark, root).select("url", "commit_hash", "event_id", "needs_scan")


def commit_scan_requests(spark: SparkSession, folder: str) -> DataFrame:
    return P.commit_scan_requests(Host(spark, folder).repositories())


def commit_requests_taken(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories after the requests of every other one became scans."""
    repositories = Host(spark, folder).repositories()
    requests = P.commit_scan_requests(repositories).filter(F.col("repository_id") % 2 == 0)
    return P.take_requests(repositories, requests).select("id", "needs_scan")


def new_scan_ids(spark: SparkSession, folder: str) -> DataFrame:
    """How many requested scans got an id of their own above every stored one."""
    host = Host(spark, folder)
    requests = P.with_scan_ids(P.commit_scan_requests(host.repositories()), host.scans())
    stored = host.scans().agg(F.max("id")).scalar()
    return requests.agg(
        F.count("*").alias("requests"),
        F.count_distinct("id").alias("ids"),
        F.coalesce(F.bool_and(F.col("id") > stored), F.lit(True)).alias("above_stored"),
    )


def due_scans(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return P.due_scans(host.repositories(), host.scans(), F.lit(_NOW).cast("timestamp"))


def reconciled_scans(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return P.reconcile(host.scans(), host.jobs()).select("id", "job_id", "status")


def scan_overview(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    return P.scan_overview(host.scans(), host.jobs())


def _totals(host: Host) -> DataFrame:
    return host.scans().select(F.col("id").alias("scan_id"), "total_progress")


def scan_progress(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    units = host.table("events").select(F.col("user_id").alias("scan_id"))
    return P.progress(P.units_done(units), _totals(host))


def scan_progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    host, root = Host(spark, folder), shared_path(spark, "progress")
    S.roll_up_progress(host.event_stream().select(F.col("user_id").alias("scan_id")), root)
    return P.progress(S.rolled_up(spark, root), _totals(host))


def scan_progress_until_done(spark: SparkSession, folder: str) -> DataFrame:
    """Units of work count until a scan has all of them; then it leaves the state."""
    host, root = Host(spark, folder), shared_path(spark, "units")
    events = host.event_stream().select(F.col("user_id").alias("scan_id"), F.col("ts").cast("timestamp").alias("ts"))
    units = events.join(_totals(host), "scan_id", "left")
    K.count_units(units, root)
    return K.counted_units(spark, root)


def ingested_findings_stream(spark: SparkSession, folder: str) -> DataFrame:
    host, root = Host(spark, folder), shared_path(spark, "reports")
    host.reports().write.parquet(f"{root}/raw")
    S.ingest_reports(S.report_stream(spark, f"{root}/raw"), f"{root}/findings")
    columns = ["id", "scan_id", "file_path", "line_number", "code_snippet", "description", "severity", "status"]
    return spark.read.parquet(f"{root}/findings/table").select(columns)


def ingest_rejects_stream(spark: SparkSession, folder: str) -> DataFrame:
    host, root = Host(spark, folder), shared_path(spark, "reports")
    host.reports().write.parquet(f"{root}/raw")
    S.ingest_reports(S.report_stream(spark, f"{root}/raw"), f"{root}/findings")
    rejects = spark.read.parquet(f"{root}/findings/rejects")
    return rejects.groupBy("tool", "reject_reason").agg(F.count("*").alias("n"))


def _without_failed_scans(host: Host) -> dict[str, DataFrame]:
    failed = host.scans().filter(F.col("status") == "failed").select(F.col("id").alias("scan_id"))
    store = {
        "scan": host.scans(),
        "findings": host.lines(),
        "evidence": host.evidence(),
        "quality_metric": host.metrics(),
    }
    return M.delete_scans(store, failed)


def findings_after_delete(spark: SparkSession, folder: str) -> DataFrame:
    return _without_failed_scans(Host(spark, folder))["findings"].select("id", "scan_id")


def evidence_after_delete(spark: SparkSession, folder: str) -> DataFrame:
    return _without_failed_scans(Host(spark, folder))["evidence"].select("finding_id", "type")


def metrics_after_delete(spark: SparkSession, folder: str) -> DataFrame:
    return _without_failed_scans(Host(spark, folder))["quality_metric"].select("id", "scan_id")


def messages_after_reset(spark: SparkSession, folder: str) -> DataFrame:
    """Finding threads that hold a system message are reset."""
    messages = Host(spark, folder).messages().withColumnRenamed("thread_id", "finding_id")
    ids = messages.filter(F.col("sender") == "system").select(F.col("finding_id").alias("id"))
    return M.delete_threads(messages, "finding", ids).select("finding_id", "turn", "sender")


def upserted_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Answers replace the user message before them, or are added where there is none."""
    messages = Host(spark, folder).messages()
    old = messages.filter(F.col("sender") != "assistant")
    new = messages.filter(F.col("sender") == "assistant").withColumn("turn", F.col("turn") - 1)
    return M.upsert(old, new, ["thread_id", "turn"], ["turn", "message"])


def rechecked_findings(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    number = F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit("e-2\n"))
    answer = F.when(F.col("event_type") == "error", "no idea").otherwise(number)
    events = host.table("events").select("user_id", "ts", "event_id", answer.alias("answer"))
    lines = host.table("lineitem").withColumn("id", Host.line_id())
    answers = lines.join(events, F.col("user_id") == F.col("l_orderkey")).select("id", "ts", "event_id", "answer")
    return M.merge_scores(host.lines(), answers, "id", ["ts", "event_id"]).select("id", "confidence_score")


QUERIES = [
    push_intake,
    push_intake_stream,
    first_seen_repositories,
    first_seen_repositories_stream,
    new_commits_by_poll,
    new_commits,
    commit_state_stream,
    commit_state_with_requests,
    commit_scan_requests,
    commit_requests_taken,
    new_scan_ids,
    due_scans,
    reconciled_scans,
    scan_overview,
    scan_progress,
    scan_progress_stream,
    scan_progress_until_done,
    ingested_findings_stream,
    ingest_rejects_stream,
    findings_after_delete,
    evidence_after_delete,
    metrics_after_delete,
    messages_after_reset,
    upserted_messages,
    rechecked_findings,
]
