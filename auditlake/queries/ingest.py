"""Registered queries: report dialects, advisory and quality outputs, ref listings, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.plans import quality_ingest
from auditlake.sources import quality_reports as Q
from auditlake.sources import reports as R
from auditlake.sources import store
from auditlake.session import shared_path
from auditlake.sources.adapters import Host

_PARSED = ["report_path", "file_path", "line_number", "code_snippet", "description", "severity"]


def _dialect(tool: str, extra: tuple[str, ...] = ()):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        parsed = R.parse_reports(Host(spark, folder).reports(tool))
        return R.reported_findings(parsed).select(*_PARSED, *extra)

    query.__name__ = f"{tool}_findings"
    return query


def report_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rejected = R.rejected_reports(R.parse_reports(Host(spark, folder).reports()))
    return rejected.groupBy("tool", "reject_reason").agg(F.count("*").alias("n"))


def fenced_answers(spark: SparkSession, folder: str) -> DataFrame:
    body = F.to_json(F.struct("turn", "role"))
    fenced = F.concat(F.col("text"), F.lit("\n```json\n"), body, F.lit("\n```\n"), F.col("text"))
    answer = F.when(F.col("role") == "assistant", fenced).when(F.col("role") == "user", F.col("text")).otherwise(body)
    rows = Host(spark, folder).table("conversations")
    return rows.select("conv_id", "turn", text.fenced_json(answer).alias("json"))


def reported_advisories(spark: SparkSession, folder: str) -> DataFrame:
    summary = F.when(F.col("p_size") > 10, F.col("p_name")).alias("summary")
    vulns = F.array(F.struct(F.concat(F.lit("ADV-"), "p_partkey").alias("id"), summary)).alias("vulns")
    package = F.struct(F.col("p_brand").alias("name"), F.col("p_size").alias("version")).alias("package")
    document = F.to_json(F.struct(F.array(F.struct(package, vulns)).alias("results")))
    cut = F.when(F.col("p_type") == "SMALL", F.substr(document, F.lit(1), F.lit(30))).otherwise(document)
    return R.advisories(Host(spark, folder).table("part").select(cut.alias("text")))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return Host(spark, folder).table("lineitem").withColumn("id", Host.line_id())


def javascript_quality(spark: SparkSession, folder: str) -> DataFrame:
    facts = F.struct(
        F.col("l_extendedprice").alias("maintainability"),
        F.when(F.col("l_returnflag") != "A", F.col("l_linenumber")).alias("cyclomatic"),
        F.col("l_quantity").cast("int").alias("sloc"),
    ).alias("complexity")
    document = F.to_json(F.struct(F.struct(F.array(F.struct(facts)).alias("reports")).alias("summary")))
    return _lines(spark, folder).select("id", Q.javascript(document).alias("m")).select("id", "m.*")


def ruby_quality(spark: SparkSession, folder: str) -> DataFrame:
    methods = F.array(F.struct(F.col("l_quantity").alias("complexity")), F.struct(F.col("l_tax").alias("complexity")))
    module = F.struct(
        F.lower("l_returnflag").alias("rating"), F.col("l_linenumber").alias("lines_of_code"), methods.alias("methods")
    )
    document = F.to_json(F.struct(F.array(module).alias("analysed_modules")))
    return _lines(spark, folder).select("id", Q.ruby(document).alias("m")).select("id", "m.*")


def rust_quality(spark: SparkSession, folder: str) -> DataFrame:
    metrics = F.struct(
        F.struct(F.col("l_quantity").alias("sum")).alias("cyclomatic"),
        F.struct(F.col("l_extendedprice").alias("mi_original")).alias("mi"),
    )
    space = F.struct(
        F.struct(
            F.col("l_linenumber").alias("loc"),
            F.col("l_suppkey").alias("lloc"),
            F.when(F.col("l_returnflag") != "A", F.col("l_linenumber")).alias("comments"),
        ).alias("metrics")
    )
    document = F.to_json(F.struct(metrics.alias("metrics"), F.array(space).alias("spaces")))
    output = F.concat(document, F.lit('\n{"metrics": {}}\n'))
    return _lines(spark, folder).select("id", Q.rust(output).alias("m")).select("id", "m.*")


def text_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Complexity listing, coverage XML, duplication text, lint and cohesion JSON of one line each."""
    n, m = F.col("l_linenumber"), F.col("l_suppkey")
    listing = F.format_string("\n%d main f a.go:1:1\n%d main g a.go:9:1\n  7 indented\n", n, m)
    coverage = F.format_string('<coverage line-rate="%s"><packages/></coverage>', F.col("l_tax").cast("string"))
    duplication = F.format_string("Found a %d line duplication\n===\nFound a %d line duplication in", n, m)
    lint = F.when(F.col("l_returnflag") == "A", "oops").otherwise(F.to_json(F.array_repeat(F.struct(n), n)))
    modules = F.create_map(
        F.lit("a"),
        F.struct(n.alias("lcom4"), F.lit(None).cast("int").alias("ic")),
        F.lit("b"),
        F.struct(F.lit(1).alias("lcom4"), n.alias("ic")),
    )
    cohesion = Q.cohesion(F.to_json(modules))
    return _lines(spark, folder).select(
        "id",
        Q.go_complexity(listing).alias("go_complexity"),
        text.half_up(Q.coverage_percent(coverage), 6).alias("coverage"),
        Q.duplicated_lines(duplication).alias("duplicated_lines"),
        Q.lint_issues(lint).alias("linter_issues"),
        cohesion["coupling"].alias("coupling"),
        cohesion["cohesion"].alias("cohesion"),
    )


_FIGURES = ["maintainability_index", "code_coverage", "coupling", "cohesion", "bug_risk_score"]


def ingested_quality_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Raw quality reports as stored metric rows, with the churn of some files."""
    host = Host(spark, folder)
    churned = host.table("lineitem").select(
        F.col("l_orderkey").alias("scan_id"),
        F.concat(F.lit("src/"), host.line_id()).alias("path"),
        F.when(F.col("l_linestatus") == "O", F.col("l_partkey") % 5).otherwise(0).alias("code_churn"),
    )
    rows, _ = quality_ingest.ingest_quality(host.quality_reports(), churned.dropDuplicates(["scan_id", "path"]))
    return rows.drop("halstead_volume").withColumns({c: text.half_up(F.col(c), 4) for c in _FIGURES})


def quality_report_rejects(spark: SparkSession, folder: str) -> DataFrame:
    _, rejects = quality_ingest.ingest_quality(Host(spark, folder).quality_reports())
    return rejects.groupBy("tool", "scanner", "reject_reason").agg(F.count("*").alias("n"))


def ref_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Remote listings spelled from scans: the head line, then one line per branch."""
    key = F.md5(F.col("o_orderkey").cast("string"))
    branch = F.lower(F.substr("o_orderpriority", F.lit(3), F.lit(20)))
    listing = F.concat(F.lit("ref: refs/heads/"), F.translate(branch, " ", "-"), F.lit("\tHEAD\n"), key, F.lit("\tHEAD"))
    line = F.concat(key, F.lit("\trefs/heads/feature/"), F.translate(branch, " ", "-"))
    return Host(spark, folder).table("orders").select(
        F.col("o_orderkey").alias("id"),
        text.primary_branch(listing).alias("primary_branch"),
        text.branch_of_ref(line).alias("branch"),
        text.first_hash(line).alias("latest_hash"),
    )


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Documents laid out as text files below a folder of their source, listed and measured."""
    root = shared_path(spark, "tree")
    Host(spark, folder).table("documents").select("source", "text").write.partitionBy("source").text(root)
    files = store.file_inventory(spark, root, "part-*")
    repo = F.replace("repo", F.lit("source="), F.lit("")).alias("repo")
    return files.groupBy(repo).agg(F.sum("length").alias("bytes"))


QUERIES = [
    *[_dialect(tool) for tool in ("semgrep", "bandit", "brakeman", "njsscan", "gosec", "cppcheck", "gitleaks")],
    _dialect("model", ("confidence_score",)),
    _dialect("misconfiguration"),
    report_rejects,
    fenced_answers,
    reported_advisories,
    javascript_quality,
    ruby_quality,
    rust_quality,
    text_quality,
    ingested_quality_metrics,
    quality_report_rejects,
    ref_listings,
    file_inventory,
]
