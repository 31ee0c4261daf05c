"""Registered queries over the file corpus: rules, secrets, metrics, churn, duplicates, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import half_up
from auditlake.operators import duplicates, rule_packs, rules
from auditlake.plans import quality as Q
from auditlake.sources.adapters import Host


# A rule for the hosted documents, whose language is that of their prose.
HOST_RULES = [*rules.RULES, rules.Rule("noise", r"(\$\$\$|%%%|###)", "INFO", "Placeholder characters", "en")]
ANCHORED_RULES = [
    rules.Rule("opening", r"^The ", "INFO", "Opens with an article"),
    rules.Rule("closing", r"ing\.$", "INFO", "Closes with a participle"),
    rules.Rule("short", r"^[A-Za-z]+\.$", "WARNING", "One word"),
]


def anchored_rule_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that hold for a whole line, wherever it stands in its file."""
    hits = rules.rule_scan(Host(spark, folder).files(), ANCHORED_RULES)
    return hits.select("path", "line_number", "rule_id")


def rule_scan(spark: SparkSession, folder: str) -> DataFrame:
    hits = rules.rule_scan(Host(spark, folder).files(), HOST_RULES)
    return hits.select("path", "line_number", "code_snippet", "rule_id", "severity", "description")


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    hits = rules.secret_scan(Host(spark, folder).files(), salt="of the host|")
    return hits.select("path", "line_number", "rule_id", "severity", "description", "code_snippet", "fingerprint")


QUOTED_RULES = [
    rules.Rule("nothing", r"(zzzz)", "INFO", "Never met"),
    rules.Rule("quoted", r"(?<mark>['\"])[0-9a-z]+\1", "INFO", "Quoted word"),
    rules.Rule("quoted-again", r"= (?<mark>['\"])[0-9a-z]+\k<mark>", "WARNING", "Assigned word"),
    rules.Rule("end", r"(?:ing|ent)\.$", "INFO", "Ending"),
]


def quoted_rule_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Rules with numbered and named groups next to each other."""
    hits = rules.rule_scan(Host(spark, folder).files(), QUOTED_RULES)
    return hits.select("path", "line_number", "rule_id")


def rule_pack_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A rule for every part over files of part names."""
    host = Host(spark, folder)
    hits = rule_packs.rule_pack_scan(host.part_files(), host.part_rules())
    return hits.select("path", "line_number", "code_snippet", "rule_id", "description")


def line_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return Q.file_metrics(Host(spark, folder).files()).select("path", "lines", "blank", "comments", "sloc")


def code_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return Q.file_metrics(Host(spark, folder).files()).select("path", "cyclomatic_complexity")


def halstead_volume(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.file_metrics(Host(spark, folder).files())
    return rows.select("path", half_up(F.col("halstead_volume"), 4).alias("halstead_volume"))


def maintainability_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.file_metrics(Host(spark, folder).files())
    return rows.select("path", half_up(F.col("maintainability_index"), 4).alias("maintainability_index"))


def code_churn(spark: SparkSession, folder: str) -> DataFrame:
    return Q.churn(Host(spark, folder).commits())


def code_churn_renamed(spark: SparkSession, folder: str) -> DataFrame:
    """Churn after each file was renamed to the one of the next number, and that one to the next, to the last."""
    commits = Host(spark, folder).commits()
    renames = commits.select("repo", F.col("file").alias("old_file"), (F.col("file") + 20).alias("new_file")).distinct()
    return Q.churn(Q.follow_renames(commits, renames))


def bug_risk(spark: SparkSession, folder: str) -> DataFrame:
    host = Host(spark, folder)
    commits = host.commits().select(
        F.concat(F.lit("src"), "repo").alias("repo"),
        F.concat(F.lit("src"), "repo", F.lit("/"), "file").alias("file"),
        "commit_hash",
    )
    risk = Q.bug_risk(Q.file_metrics(host.files()), Q.churn(commits))
    return risk.select("path", "cyclomatic_complexity", "code_churn", "bug_risk_score")


def project_metrics(spark: SparkSession, folder: str) -> DataFrame:
    merged = Q.project_metrics(Host(spark, folder).scanner_results())
    return merged.select("repo", *[half_up(F.col(c), 4).alias(c) for c in Q.AVERAGED], *Q.SUMMED)


def assembled_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """File rows of documents with their repository's project metrics; some rows know their own coverage."""
    host = Host(spark, folder)
    project = Q.project_metrics(host.scanner_results()).withColumn("repo", F.concat(F.lit("src"), "repo"))
    own = F.when(F.col("language") == "en", F.lit(50.0)).alias("code_coverage")
    rows = Q.file_metrics(host.files()).select("repo", "path", "sloc", own)
    columns = [half_up(F.col(c), 4).alias(c) for c in Q.AVERAGED]
    return Q.assemble(rows, project).select("path", "sloc", *columns, *Q.SUMMED)


def duplicated_lines_by_file(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.duplicated_lines_by_file(Host(spark, folder).files())


def duplicated_line_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.duplicated_ranges(Host(spark, folder).files())


def duplicated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.duplicated_lines(Host(spark, folder).files())


def diff_added_lines(spark: SparkSession, folder: str) -> DataFrame:
    return rules.added_lines(Host(spark, folder).diffs())


def diff_scan(spark: SparkSession, folder: str) -> DataFrame:
    hits = rules.diff_scan(Host(spark, folder).diffs())
    return hits.select("commit_hash", "path", "line_number", "rule_id", "severity")


QUERIES = [
    rule_scan,
    anchored_rule_scan,
    secret_scan,
    line_metrics,
    code_complexity,
    halstead_volume,
    maintainability_index,
    code_churn,
    code_churn_renamed,
    bug_risk,
    project_metrics,
    assembled_metrics,
    duplicated_lines_by_file,
    duplicated_line_ranges,
    duplicated_lines,
    quoted_rule_scan,
    rule_pack_scan,
    diff_added_lines,
    diff_scan,
]
