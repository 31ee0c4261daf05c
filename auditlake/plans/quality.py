"""Quality facts of repositories and files: metrics, churn, risk, project-wide merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import metrics as M
from auditlake.session import written

# Project-wide metrics; the first three are averaged over scanners, the rest summed.
AVERAGED = ["code_coverage", "coupling", "cohesion"]
SUMMED = ["tests_passing", "duplicated_lines", "linter_issues"]


def file_metrics(files: DataFrame) -> DataFrame:
    """(repo, path, language, content) -> metrics of each file; the content leaves in the same stage."""
    kept = [c for c in files.columns if c != "content"]
    index = M.maintainability_index(
        F.col("halstead_volume"), F.col("cyclomatic_complexity"), F.col("sloc"), F.col("comments")
    )
    return (
        files.withColumns(M.file_metrics(F.col("content"), F.col("language")))
        .select(*kept, "lines", "blank", "comments", "sloc", "cyclomatic_complexity", "halstead_volume")
        .withColumn("maintainability_index", index)
    )


def churn(commits: DataFrame) -> DataFrame:
    """Commits that touched each file."""
    return commits.groupBy("repo", "file").agg(F.count_distinct("commit_hash").alias("code_churn"))


def last_names(renames: DataFrame) -> DataFrame:
    """(repo, old_file, new_file): each renamed file with the end of its chain of renames.

    The table is joined with itself, which doubles the hops it spans, until no name
    moves: a chain of n renames takes log2(n) joins. Of several renames of a file
    the last by name counts; files whose chain runs into a cycle have no end and
    are left out.
    """
    table = written(renames.groupBy("repo", "old_file").agg(F.max("new_file").alias("new_file")), "renames")
    for _ in range(table.count().bit_length() + 1):
        onward = table.select("repo", F.col("old_file").alias("new_file"), F.col("new_file").alias("_next"))
        moved = table.join(onward, ["repo", "new_file"], "left")
        table = written(
            moved.select("repo", "old_file", F.coalesce("_next", "new_file").alias("new_file"), F.col("_next").isNotNull().alias("_open")),
            "renames",
        )
        if table.filter("_open").isEmpty():
            break
    return table.filter(~F.col("_open")).drop("_open") if "_open" in table.columns else table


def follow_renames(commits: DataFrame, renames: DataFrame) -> DataFrame:
    """Count a file's commits under its present name.

    ``renames`` is (repo, old_file, new_file); files never renamed keep their name.
    """
    return (
        commits.join(last_names(renames).withColumnRenamed("old_file", "file"), ["repo", "file"], "left")
        .withColumn("file", F.coalesce("new_file", "file"))
        .drop("new_file")
    )


def bug_risk(metrics: DataFrame, churned: DataFrame) -> DataFrame:
    """Complexity times churn; a file no commit touched has churn 0."""
    changes = F.coalesce("code_churn", F.lit(0).cast("bigint"))
    return (
        metrics.join(churned.withColumnRenamed("file", "path"), ["repo", "path"], "left")
        .withColumn("code_churn", changes)
        .withColumn("bug_risk_score", (F.col("cyclomatic_complexity") * changes).cast("double"))
    )


def project_metrics(scanner_results: DataFrame) -> DataFrame:
    """One row per (repo, scanner) -> one per repository.

    Every scanner that ran counts in the averages, also one that reported
    nothing; missing values add 0.
    """

    def total(name: str):
        return F.sum(F.coalesce(name, F.lit(0)))

    return scanner_results.groupBy("repo").agg(
        *[(total(name) / F.count("*")).alias(name) for name in AVERAGED],
        *[total(name).cast("bigint").alias(name) for name in SUMMED],
    )


def assemble(file_rows: DataFrame, project_rows: DataFrame) -> DataFrame:
    """Project values copied onto each file row; a file's own value wins, coupling and cohesion default to 0."""
    project = project_rows.select("repo", *[F.col(name).alias(f"_{name}") for name in AVERAGED + SUMMED])
    joined = file_rows.join(project, "repo", "left")
    for name in AVERAGED + SUMMED:
        value = F.col(f"_{name}")
        if name in file_rows.columns:
            value = F.coalesce(F.col(name), value)
        if name in ("coupling", "cohesion"):
            value = F.coalesce(value, F.lit(0.0))
        joined = joined.withColumn(name, value).drop(f"_{name}")
    return joined
