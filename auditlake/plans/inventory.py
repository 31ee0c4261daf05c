"""Facts about checked-out files: language ranking and the work a deep scan has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import paths


def language_ranking(files: DataFrame) -> DataFrame:
    """Per repository its languages, most files first, then by name; the first is primary.

    Files are counted before anything is listed, so a list holds one entry per
    known language whatever the repository's size.
    """
    counts = (
        files.select("repo", paths.language_of_path(F.col("path")).alias("language"))
        .filter(F.col("language").isNotNull())
        .groupBy("repo", "language")
        .agg(F.count("*").alias("n"))
    )
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "language")))
    return (
        counts.groupBy("repo")
        .agg(ranked.alias("ranked"))
        .select("repo", F.col("ranked.language").alias("languages"))
        .withColumn("primary_language", F.element_at("languages", 1))
    )


def work_estimate(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """Units of work per repository: every file list a deep scan walks, plus two advisory steps."""
    path = F.col("path")
    counts = files.groupBy("repo").agg(
        F.count_if(paths.in_scan_tree(path, include_tests)).alias("rule_files"),
        F.count_if(paths.is_source_file(path, include_tests)).alias("source_files"),
        F.count("*").alias("secret_files"),
        F.count_if(paths.is_config_file(path)).alias("config_files"),
        F.count_if(paths.is_source_file(path)).alias("quality_files"),
    )
    total = sum((F.col(c) for c in counts.columns[1:]), F.lit(2))
    return counts.withColumn("total_progress", total)


def _with_exclusion(files: DataFrame, repositories: DataFrame) -> DataFrame:
    """Files with ``excluded``: hit by a global pattern or by their own repository's comma list.

    The global patterns are constants; a repository's list is folded into one
    regex and reaches only its own files, through an equi-join on the repository.
    """
    rooted = F.concat(F.lit("/"), F.col("path"))
    own = (
        repositories.select("repo", F.explode(F.split("sast_exclusions", ",")).alias("pattern"))
        .filter(F.trim("pattern") != "")
        .groupBy("repo")
        .agg(F.array_join(F.collect_set(paths.exclusion_regex(F.col("pattern"))), "|").alias("_own"))
    )
    hit = F.coalesce(F.rlike(rooted, F.col("_own")), F.lit(False))
    for pattern in paths.GLOBAL_EXCLUSIONS:
        hit = hit | F.rlike(rooted, paths.exclusion_regex(F.lit(pattern)))
    return files.join(own, "repo", "left").withColumn("excluded", hit).drop("_own")


def excluded_paths(files: DataFrame, repositories: DataFrame) -> DataFrame:
    return _with_exclusion(files, repositories).filter("excluded").drop("excluded")


def without_exclusions(files: DataFrame, repositories: DataFrame) -> DataFrame:
    return _with_exclusion(files, repositories).filter(~F.col("excluded")).drop("excluded")
