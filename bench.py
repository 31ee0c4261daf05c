"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections import defaultdict
from pathlib import Path

from auditlake.queries.registry import queries
from auditlake.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "findings_by_severity",
    "findings_by_repository",
    "findings_by_repository_language",
    "finding_density",
    "top_descriptions",
    "quality_by_repository",
    "scan_listing",
    "ingested_findings",
    "source_check_counts",
    "linked_cves",
    "rule_scan",
    "secret_scan",
    "maintainability_index",
    "duplicated_lines",
    "new_commits_by_poll",
    "scan_progress_stream",
]


def run(query, spark) -> float:
    start = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def moved(folder: str) -> dict[str, list[float]]:
    """MB shuffled and spilled per query's warm run, from the event log; streams run their jobs in groups of their own."""
    groups, found = {}, defaultdict(lambda: [0.0, 0.0])
    for file in Path(folder).iterdir():
        for line in file.open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerStageSubmitted":
                groups[event["Stage Info"]["Stage ID"]] = (event.get("Properties") or {}).get("spark.jobGroup.id")
            elif event["Event"] == "SparkListenerTaskEnd" and (group := groups.get(event["Stage ID"])):
                metrics = event.get("Task Metrics") or {}
                found[group][0] += metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0) / 1e6
                found[group][1] += metrics.get("Disk Bytes Spilled", 0) / 1e6
    return {group: [round(x, 1) for x in values] for group, values in found.items() if group in HEADLINE}


def main() -> None:
    log = tempfile.mkdtemp(prefix="bench-events-")
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": Path(log).as_uri(),
            "spark.eventLog.compress": "false",
            "spark.eventLog.rolling.enabled": "false",
            "auditlake.spread": CPUS,  # the tables are single row groups, which one task would read and work on
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    cold, warm = {}, {}
    for name in HEADLINE:
        spark.sparkContext.setJobGroup(f"cold {name}", name)
        cold[name] = round(run(known[name], spark), 3)
        spark.sparkContext.setJobGroup(name, name)
        warm[name] = round(run(known[name], spark), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "shuffle_and_spill_mb": moved(log),
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
