"""Change feed: push events, new commits, scan requests, due scans, scan states.

All functions take and give DataFrames; the push ones work on streams as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.joins import spread_key
from auditlake.operators.latest import last_scan_by_time
from auditlake.session import written

# Fixed value: the hash a push carries when its branch was deleted.
NO_COMMIT = "0" * 40
PUSH_BODY = "repository struct<clone_url:string,full_name:string>, after string"


def classify_pushes(events: DataFrame) -> DataFrame:
    """(event_id, ts, event_type, body) -> parsed push with its ``outcome``, row by row."""
    push = F.from_json("body", PUSH_BODY)
    url, name, after = (F.col(f"push.{c}") for c in ("repository.clone_url", "repository.full_name", "after"))
    outcome = (
        F.when(~F.col("event_type").eqNullSafe("push"), "not a push")
        .when(url.isNull() | name.isNull() | after.isNull(), "invalid payload")
        .when(after == NO_COMMIT, "branch deleted")
        .otherwise("accepted")
    )
    return events.withColumn("push", push).select(
        "event_id", "ts", url.alias("url"), name.alias("full_name"), after.alias("commit_hash"), outcome.alias("outcome")
    )


def accepted_pushes(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("outcome") == "accepted").drop("outcome")


def first_seen(pushes: DataFrame, repositories: DataFrame) -> DataFrame:
    """A new repository row per unknown URL, named by its earliest push."""
    name = F.min_by("full_name", F.struct("ts", "event_id")).alias("name")
    return pushes.groupBy("url").agg(name).join(repositories.select("url"), "url", "left_anti")


def latest_push(pushes: DataFrame) -> DataFrame:
    """Newest push per URL by (ts, event_id): one row per repository leaves each task."""
    newest = F.max_by(F.struct("commit_hash", "ts", "event_id"), F.struct("ts", "event_id")).alias("p")
    return pushes.groupBy("url").agg(newest).select("url", "p.*")


def advance_state(state: DataFrame, pushes: DataFrame) -> DataFrame:
    """Commit state per URL after some more pushes.

    State and pushes are stacked and aggregated once. An older push never
    replaces a newer one and a replayed push changes nothing, so the result does
    not depend on how pushes are cut into batches. A changed hash sets
    ``needs_scan``; the first hash is a change.
    """
    stored = state.select("url", "commit_hash", "ts", "event_id", "needs_scan", F.lit(True).alias("stored"))
    arrived = latest_push(pushes).withColumns({"needs_scan": F.lit(False), "stored": F.lit(False)})
    row = F.max_by(F.struct("commit_hash", "ts", "event_id"), F.struct("ts", "event_id", "stored")).alias("p")
    before = F.max(F.when(F.col("stored"), F.col("commit_hash"))).alias("before")
    waiting = F.max("needs_scan").alias("waiting")
    return (
        stored.unionByName(arrived)
        .groupBy("url")
        .agg(row, before, waiting)
        .select("url", "p.*", (F.col("waiting") | ~F.col("p.commit_hash").eqNullSafe(F.col("before"))).alias("needs_scan"))
    )


def new_commits_by_poll(pushes: DataFrame, interval: str = "5 minutes") -> DataFrame:
    """What a poll every ``interval`` sees: polls whose latest hash differs from the one before.

    Pushes are reduced to one hash per repository and poll before any ordering,
    so a repository's window holds at most one row per poll of the covered time.
    """
    from pyspark.sql import Window

    seen = (
        pushes.filter(F.col("commit_hash").isNotNull())
        .groupBy("url", F.window("ts", interval).alias("w"))
        .agg(F.max_by("commit_hash", F.struct("ts", "event_id")).alias("commit_hash"))
    )
    before = F.lag("commit_hash").over(Window.partitionBy("url").orderBy("w"))
    return (
        seen.withColumn("previous_hash", before)
        .filter(~F.col("commit_hash").eqNullSafe(F.col("previous_hash")))
        .select("url", F.col("w.end").alias("polled_at"), "commit_hash", "previous_hash")
    )


def detect_new_commits(repositories: DataFrame, refs: DataFrame) -> DataFrame:
    """Repositories after one poll of (url, commit_hash); a missing hash changes nothing.

    Where a URL is listed more than once, the row of its primary branch counts if
    ``refs`` has ``branch``, then the newest by ``ts`` if it has that, then the
    largest hash.
    """
    rank = [F.col("ts")] if "ts" in refs.columns else []
    known = refs.filter(F.col("commit_hash").isNotNull())
    if "branch" in refs.columns:
        primary = repositories.select("url", F.col("primary_branch").alias("branch"))
        known = known.join(primary, ["url", "branch"], "left_semi")
    newest = F.max_by("commit_hash", F.struct(*rank, "commit_hash")).alias("_seen")
    seen = known.groupBy("url").agg(newest)  # one row a repository
    changed = F.col("_seen").isNotNull() & ~F.col("_seen").eqNullSafe(F.col("last_commit_hash"))
    return (
        repositories.join(seen, "url", "left")
        .withColumns(
            {
                "needs_scan": F.coalesce("needs_scan", F.lit(False)) | changed,
                "last_commit_hash": F.when(changed, F.col("_seen")).otherwise(F.col("last_commit_hash")),
            }
        )
        .drop("_seen")
    )


def commit_scan_requests(repositories: DataFrame) -> DataFrame:
    """A queued commit scan for every repository that waits for one."""
    return repositories.filter("needs_scan").select(
        F.col("id").alias("repository_id"),
        F.lit("commit").alias("scan_type"),
        F.lit("queued").alias("status"),
        F.col("last_commit_hash").alias("triggering_commit_hash"),
    )


def take_requests(repositories: DataFrame, requests: DataFrame) -> DataFrame:
    """The repository snapshot after some requests became scans.

    A request clears its repository's flag only if the repository is still at the
    commit that the request is for; a push in between keeps the flag.
    """
    taken = requests.groupBy(F.col("repository_id").alias("id"), F.col("triggering_commit_hash").alias("_hash")).agg(F.lit(True).alias("_taken"))
    same = (F.col("r.id") == F.col("t.id")) & F.col("r.last_commit_hash").eqNullSafe(F.col("t._hash"))
    cleared = F.col("r.needs_scan") & F.col("t._taken").isNull()
    columns = [cleared.alias(c) if c == "needs_scan" else F.col(f"r.{c}") for c in repositories.columns]
    return repositories.alias("r").join(taken.alias("t"), same, "left").select(columns)


def with_scan_ids(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """Ids above all stored ones: unique and growing, not dense.

    The requests are written with their ids once, so that inserting the scans and
    clearing the flags see the same ones however often the result is evaluated.
    """
    base = F.coalesce(scans.agg(F.max("id")).scalar(), F.lit(0))
    return written(requests.withColumn("id", base + 1 + F.monotonically_increasing_id()), "scan-requests")


def due_scans(repositories: DataFrame, scans: DataFrame, now: Column) -> DataFrame:
    """Repositories with periodic scans on whose last deep scan is missing or too old."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    return (
        repositories.filter("periodic_scan_enabled")
        .withColumnRenamed("id", "repository_id")
        .join(last_scan_by_time(scans, "deep"), "repository_id", "left")
        .filter(F.col("created_at").isNull() | (age > F.col("periodic_scan_interval")))
        .select("repository_id", "url", F.col("scan_id").alias("last_scan_id"))
    )


def _one_per_job(jobs: DataFrame) -> DataFrame:
    """(_key, job_status): a job listed twice counts as failed if one of its rows says so."""
    failed = F.max(F.when(F.col("job_status") == "failed", F.col("job_status")))
    return jobs.groupBy(F.col("job_id").alias("_key")).agg(F.coalesce(failed, F.max("job_status")).alias("job_status"))


def reconcile(scans: DataFrame, jobs: DataFrame) -> DataFrame:
    """Open scans without a job, with an unknown job or with a failed one become failed."""
    is_open = F.col("status").isin("running", "queued")
    key = spread_key(F.col("job_id"), is_open, F.col("id").cast("string"))
    lost = is_open & (F.col("job_status").isNull() | (F.col("job_status") == "failed"))
    return (
        scans.withColumn("_key", key)
        .join(_one_per_job(jobs), "_key", "left")
        .withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))
        .drop("_key", "job_status")
    )


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(0.0)


def scan_overview(scans: DataFrame, jobs: DataFrame) -> DataFrame:
    """The scan table as shown: job if it still exists, progress in percent, short hash, N/A for gaps."""
    key = spread_key(F.col("job_id"), F.lit(True), F.col("id").cast("string"))
    na = F.lit("N/A")
    return (
        scans.withColumn("_key", key)
        .join(_one_per_job(jobs), "_key", "left")
        .select(
            "id",
            "status",
            F.when(F.col("job_status").isNotNull(), F.col("job_id")).alias("job_id"),
            percent(F.col("progress"), F.col("total_progress")).alias("percent"),
            F.coalesce("branch", na).alias("branch"),
            F.coalesce(F.left("triggering_commit_hash", F.lit(7)), na).alias("commit"),
            F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), na).alias("created_at"),
        )
    )


def units_done(units: DataFrame) -> DataFrame:
    """Finished units of work per scan; counts combine before the shuffle, on streams too."""
    return units.groupBy("scan_id").agg(F.count("*").alias("progress"))


def progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    return done.join(totals, "scan_id", "left").select(
        "scan_id",
        "progress",
        percent(F.col("progress"), F.coalesce("total_progress", F.lit(0))).alias("percent"),
    )
