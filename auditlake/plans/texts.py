"""Text outputs: chat transcripts, model inputs, the nested findings report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.paths import is_config_file, is_source_file, is_test_path
from auditlake.functions.text import strip
from auditlake.operators.filters import might_hold
from auditlake.operators.segments import ordered_lists, page_of, pages


def transcripts(messages: DataFrame, thread: list[str], order: list[str], limit: int = 10_000) -> DataFrame:
    """``sender: message`` lines of each thread in order; very long threads come as several segments."""
    line = F.concat(F.col("sender"), F.lit(": "), F.col("message"))
    listed = ordered_lists(messages, thread, order, line, limit)
    return listed.select(*thread, "segment", F.array_join("items", "\n").alias("transcript"))


def model_inputs(
    files: DataFrame, findings: DataFrame, checkout: str = "scan_id", include_tests: bool = False, limit: int = 1_000
) -> DataFrame:
    """One row per source file of a checkout: content, bullets of its known findings, whether it is a test.

    ``checkout`` names the column of both sides that tells whose tree a path is in.
    Files without anything but white space are left out. A file with more findings than ``limit`` has several rows, one per segment of
    its bullets, so that no list grows without bound and none is cut.
    """
    # Fixed value: how a known finding is listed.
    bullet = F.concat(
        F.lit("- **Line "), F.coalesce(F.col("line_number").cast("string"), F.lit("None")), F.lit(":** "), "description"
    )
    known = findings.filter(F.col("file_path").isNotNull()).withColumn("path", F.col("file_path"))
    file = [checkout, "path"]
    bullets = ordered_lists(known, file, ["line_number", "description", "id"], bullet, limit).select(
        *file, "segment", F.array_join("items", "\n").alias("existing_findings")
    )
    return (
        files.filter(is_source_file(F.col("path"), include_tests) & (strip(F.col("content")) != ""))
        .join(bullets, file, "left")
        .select(
            *file,
            F.coalesce("segment", F.lit(0).cast("bigint")).alias("segment"),
            "content",
            F.coalesce("existing_findings", F.lit("")).alias("existing_findings"),
            is_test_path(F.col("path")).alias("is_test"),
        )
    )


def config_inputs(inventory: DataFrame, files: DataFrame, checkout: str = "scan_id") -> DataFrame:
    """(checkout, path, content) of the listed configuration files that hold more than white space.

    Both sides keep configuration files only before they meet, so no other content moves.
    """
    listed = inventory.filter(is_config_file(F.col("path"))).select(checkout, "path")
    contents = files.filter(is_config_file(F.col("path")) & (strip(F.col("content")) != "")).select(checkout, "path", "content")
    return contents.join(listed, [checkout, "path"], "left_semi")


def annotate(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Hook for a user's own model or analyser: ``fn`` maps an iterator of pandas batches."""
    return df.mapInPandas(fn, schema)


def nested_report(
    findings: DataFrame,
    evidence: DataFrame,
    scans: DataFrame,
    repositories: DataFrame,
    page_size: int = 10_000,
    limit: int = 1_000,
) -> DataFrame:
    """Per repository the number of its findings and the findings with their evidence.

    A finding keeps all its evidence, by type and content. A repository's list is
    paged: each row holds one page of about ``page_size`` findings next to the
    repository's total. Findings with more evidence than ``limit`` come again in
    further rows, one per segment of it: (repository, page, segment) is the key of
    the result, and segment 0 holds every finding once.

    Findings are counted by scan before any join, so whole rows move twice: to
    their scan and to their page. Only those that may have evidence meet it.
    """
    known = evidence.filter(F.col("finding_id").isNotNull())
    order = ["type", "content", *(c for c in ["id"] if c in evidence.columns)]  # pieces equal in both are alike in the list
    proofs = ordered_lists(known, ["finding_id"], order, F.struct("type", "content"), limit).select(
        F.col("finding_id").alias("id"), "segment", F.col("items").alias("evidence")
    )
    owners = scans.select(F.col("id").alias("scan_id"), "repository_id")
    counts = findings.groupBy("scan_id").agg(F.count("*").alias("_n"))
    sizes = pages(owners.join(counts, "scan_id").groupBy("repository_id").agg(F.sum("_n").alias("group_size")), page_size)
    places = owners.join(sizes, "repository_id")
    rows = findings.join(places, "scan_id").withColumn("page", page_of("id"))
    has_proof = might_hold(known.select(F.col("finding_id").cast("string")))(F.col("id").cast("string"))
    bare = rows.filter(~has_proof).withColumns({c: F.lit(None).cast(proofs.schema[c].dataType) for c in ("segment", "evidence")})
    rows = rows.filter(has_proof).join(proofs, "id", "left").unionByName(bare)
    none: Column = F.array().cast("array<struct<type:string,content:string>>")
    entry = F.struct(
        "id",
        "description",
        "file_path",
        "line_number",
        "severity",
        "status",
        "confidence_score",
        "code_snippet",
        F.coalesce("evidence", none).alias("evidence"),
    )
    names = repositories.select(F.col("id").alias("repository_id"), "name")
    each_page = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pages") - 1)).alias("page")
    named = names.join(sizes, "repository_id").select("repository_id", "name", each_page)
    place = ["repository_id", "page"]
    return (
        rows.select(
            *place,
            "pages",
            F.coalesce("segment", F.lit(0).cast("bigint")).alias("segment"),
            F.col("group_size").alias("finding_count"),
            entry.alias("entry"),
        )
        .repartition(*place)
        .groupBy(*place, "pages", "segment", "finding_count")
        .agg(F.sort_array(F.collect_list("entry")).alias("findings"))
        .join(named, place)
        .select("repository_id", "name", "finding_count", "page", "pages", "segment", "findings")
    )
