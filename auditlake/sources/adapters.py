"""The findings model hosted on the benchmark tables, column by column.

Each function is a lazy view; a query that needs no description never joins part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Host:
    """Views over one folder of benchmark parquet files."""

    def __init__(self, spark: SparkSession, folder: str, spread: int | None = None):
        """``spread``: parts that costly text work is dealt over where the caller knows the files to be few; else as they come.

        The session's ``auditlake.spread`` stands in for it, so that a caller of the queries can give it.
        """
        self.spark = spark
        self.folder = folder.rstrip("/")
        given = spark.conf.get("auditlake.spread", None)
        self.parts = spread if spread is not None else int(given) if given else None

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        return df.repartition(self.parts, key) if self.parts else df

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def repositories(self) -> DataFrame:
        name = F.col("c_name")
        exclusions = F.when(F.col("c_mktsegment") == "BUILDING", "*.rs, p1*").when(
            F.col("c_mktsegment") == "MACHINERY", "src"
        )
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            name.alias("name"),
            F.concat(
                F.lit("https://github.com/"),
                F.lower("c_mktsegment"),
                F.lit("/"),
                F.translate(name, "#", "-"),
                F.lit(".git"),
            ).alias("url"),
            F.lit("main").alias("primary_branch"),
            F.md5(F.col("c_custkey").cast("string")).alias("last_commit_hash"),
            (F.col("c_nationkey") < 12).alias("needs_scan"),
            (F.col("c_acctbal") > 0).alias("periodic_scan_enabled"),
            (F.col("c_nationkey") * 86400 * 30).alias("periodic_scan_interval"),
            exclusions.alias("sast_exclusions"),
        )

    def scans(self) -> DataFrame:
        key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
        scan_type = (
            F.when(priority == "1-URGENT", "deep")
            .when(priority == "2-HIGH", "commit")
            .when(priority == "3-MEDIUM", "test")
            .when(priority == "4-NOT SPECIFIED", "cve-linking")
            .when(priority == "5-LOW", "quality")
        )
        state = F.col("o_orderstatus")
        status = F.when(state == "F", "completed").when(state == "O", "running").when(state == "P", "failed")
        languages = (
            F.when(key % 4 == 0, F.array().cast("array<string>"))
            .when(key % 4 == 1, F.array(F.lit("Python")))
            .when(key % 4 == 2, F.array(F.lit("Go"), F.lit("Python")))
        )
        return self.table("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("repository_id"),
            scan_type.alias("scan_type"),
            status.alias("status"),
            F.when(priority != "5-LOW", F.concat(F.lit("job-"), key)).alias("job_id"),
            F.when(state != "F", "main").alias("branch"),
            F.when(priority == "2-HIGH", F.md5(key.cast("string"))).alias("triggering_commit_hash"),
            (key % 50).cast("int").alias("progress"),
            (F.col("o_custkey") % 4 * 20).cast("int").alias("total_progress"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            languages.alias("languages"),
        )

    def jobs(self) -> DataFrame:
        """Job states: one job per scan that has line items."""
        return (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(F.max("l_returnflag").alias("flag"))
            .select(
                F.concat(F.lit("job-"), F.col("l_orderkey")).alias("job_id"),
                F.when(F.col("flag") == "R", "failed").otherwise("started").alias("job_status"),
            )
        )

    @staticmethod
    def line_id() -> Column:
        return F.md5(
            F.concat_ws(
                "|",
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                F.col("l_quantity").cast("int"),
                F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            )
        )

    @staticmethod
    def line_path() -> Column:
        number = F.col("l_linenumber")
        suffix = (
            F.when(number == 1, ".py")
            .when(number == 2, ".js")
            .when(number == 3, ".go")
            .when(number == 4, ".rb")
            .when(number == 5, ".rs")
            .when(number == 6, ".TS")
            .otherwise(".md")
        )
        return F.concat(F.lit("src/f"), F.col("l_partkey") % 97, suffix)

    @staticmethod
    def raw_level() -> Column:
        levels = {"AF": "critical", "AO": "error", "NF": "warning", "NO": "Medium", "RF": "info"}
        names = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
        return F.coalesce(F.try_element_at(names, F.concat("l_returnflag", "l_linestatus")), F.lit("Weak"))

    @staticmethod
    def tool() -> Column:
        kind = F.col("l_suppkey") % 3
        return F.when(kind == 0, "semgrep").when(kind == 1, "bandit").otherwise("gitleaks")

    def lines(self) -> DataFrame:
        """Findings without their description: lineitem alone."""
        return self.described_lines(self.table("lineitem"))

    def described_lines(self, rows: DataFrame, *more: str) -> DataFrame:
        """What ``lines`` says of lineitem rows, which may be joined already."""
        from auditlake.functions.severity import map_severity

        return rows.select(
            self.line_id().alias("id"),
            F.col("l_orderkey").alias("scan_id"),
            self.line_path().alias("file_path"),
            F.col("l_linenumber").alias("line_number"),
            map_severity(self.raw_level()).alias("severity"),
            (F.col("l_discount") * 10).alias("confidence_score"),
            F.lit("new").alias("status"),
            self.tool().alias("tool"),
            F.col("l_partkey").alias("part_key"),
            *more,
        )

    def findings(self) -> DataFrame:
        """Findings with description, snippet and CVE: lineitem joined with part, before any text is spelled."""
        tool = F.col("tool")
        name, brand = F.col("p_name"), F.col("p_brand")
        description = (
            F.when(tool == "semgrep", F.concat(F.lit("semgrep: "), name, F.lit(" (https://semgrep.dev/r/"), brand, F.lit(")")))
            .when(
                tool == "bandit",
                F.concat(
                    F.lit("bandit: "),
                    name,
                    F.lit(" (https://bandit.readthedocs.io/en/latest/plugins/"),
                    brand,
                    F.lit(".html)"),
                ),
            )
            .otherwise(F.concat(F.lit("Gitleaks: "), name))
        )
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
        joined = self.table("lineitem").join(part, "l_partkey")
        return self.described_lines(joined, "p_name", "p_brand", "p_type", "p_size").select(
            "id",
            "scan_id",
            "file_path",
            "line_number",
            F.col("p_type").alias("code_snippet"),
            description.alias("description"),
            "severity",
            "confidence_score",
            "status",
            F.when(F.col("p_size") > 40, F.concat(F.lit("CVE-"), "part_key")).alias("cve_id"),
            "tool",
            F.concat_ws("/", "p_brand", "p_size").alias("package"),
        )

    def metrics(self) -> DataFrame:
        return self.table("lineitem").filter(F.col("l_linestatus") == "O").select(
            self.line_id().alias("id"),
            F.col("l_orderkey").alias("scan_id"),
            self.line_path().alias("file_path"),
            F.col("l_linenumber").alias("cyclomatic_complexity"),
            F.col("l_quantity").cast("int").alias("sloc"),
            (F.col("l_extendedprice") / 1000).alias("maintainability_index"),
            (F.col("l_tax") * 100).alias("code_coverage"),
        )

    def files(self) -> DataFrame:
        """Source files: documents, their source playing the repository."""
        return self.dealt(self.table("documents"), "doc_id").select(
            F.col("source").alias("repo"),
            F.concat_ws("/", "source", "doc_id").alias("path"),
            F.col("text").alias("content"),
            F.col("lang").alias("language"),
        )

    def checkout_files(self) -> DataFrame:
        """Source files of twenty checkouts whose paths collide: a document's path does not name its source."""
        return self.table("documents").select(
            F.col("source").alias("repo"),
            F.concat(F.lit("f/"), F.floor(F.col("doc_id") / 20)).alias("path"),
            F.col("text").alias("content"),
        )

    def dependencies(self) -> DataFrame:
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_brand").alias("package"),
            F.when(F.col("p_size") < 50, F.col("p_size").cast("string")).alias("version"),
        )
        return (
            self.table("lineitem")
            .select(F.col("l_orderkey").alias("scan_id"), "l_partkey")
            .join(part, "l_partkey")
            .select("scan_id", "package", "version")
        )

    def advisories(self) -> DataFrame:
        """Advisories of brands; those of one size are known by the same number for all its parts."""
        return self.table("part").select(
            F.col("p_brand").alias("package"),
            F.col("p_size").cast("string").alias("version"),
            F.concat(F.lit("ADV-"), "p_partkey").alias("advisory_id"),
            F.col("p_name").alias("summary"),
        )

    def package_advisories(self) -> DataFrame:
        """Advisories of brand and container, in as many versions as there are parts: some packages have one, some two."""
        return self.table("part").select(
            F.concat_ws("/", "p_brand", "p_size").alias("package"),
            F.col("p_partkey").cast("string").alias("version"),
            F.concat_ws("-", F.lit("ADV"), "p_brand", F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1)).alias("advisory_id"),
        )

    def commits(self) -> DataFrame:
        """Commit x file rows."""
        return self.table("events").select(
            (F.col("user_id") % 20).alias("repo"),
            F.col("user_id").alias("file"),
            F.col("event_id").alias("commit_hash"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("thread_id"), "turn", F.col("role").alias("sender"), F.col("text").alias("message")
        )

    def inventory(self) -> DataFrame:
        """Checked-out file paths per repository: distinct paths spelled from lineitem."""
        flag, number = F.col("l_returnflag"), F.col("l_linenumber")
        folder = F.when(flag == "A", "src/").when(flag == "N", "tests/").otherwise("pkg/build/")
        name = (
            F.when(number == 1, "f.py")
            .when(number == 2, "Dockerfile")
            .when(number == 3, "values.yaml")
            .when(number == 4, "LICENSE")
            .when(number == 5, "f.rs")
            .when(number == 6, "Gemfile")
            .otherwise("notes.md")
        )
        path = F.concat(folder, F.lit("p"), F.col("l_partkey") % 97, F.lit("/"), name)
        return self.table("lineitem").select(F.col("l_suppkey").alias("repo"), path.alias("path")).distinct()

    def inventory_contents(self) -> DataFrame:
        """Contents of the inventory's files, those of some folders blank."""
        blank = F.col("path").rlike(r"/p[0-9]?[0-4]/")
        return self.inventory().withColumn("content", F.when(blank, F.lit(" \n\t")).otherwise(F.concat(F.lit("# "), "path")))

    def page_paths(self) -> DataFrame:
        return self.table("pages").select(
            F.try_parse_url("url", F.lit("HOST")).alias("repo"), F.try_parse_url("url", F.lit("PATH")).alias("path")
        )

    def report_lines(self) -> DataFrame:
        """lineitem with its part, the raw material of the hosted reports."""
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
        return self.dealt(self.table("lineitem"), "l_orderkey").join(part, "l_partkey")

    def part_files(self) -> DataFrame:
        """One file an order: a line for each of its lines' parts."""
        line = F.concat("p_name", F.lit(" "), "p_type", F.lit("/"), "p_size")
        return self.report_lines().groupBy(F.col("l_orderkey").alias("path")).agg(
            F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("content"), F.max("l_linestatus").alias("language")
        )

    def part_rules(self) -> DataFrame:
        """One rule a part, some for one language only."""
        pattern = F.concat(F.lit("^"), F.replace("p_name", F.lit(" "), F.lit(" +")), F.lit(" "), "p_type", F.lit("/"), "p_size", F.lit("$"))
        return self.table("part").select(
            F.concat(F.lit("part-"), "p_partkey").alias("rule_id"),
            pattern.alias("pattern"),
            "p_brand",
            F.lit("INFO").alias("severity"),
            F.col("p_brand").alias("message"),
            F.when(F.col("p_partkey") % 3 == 0, "O").alias("language"),
        )

    @staticmethod
    def report_text(tool: str) -> Column:
        """One tool's report about one line; the seventh line's report is cut short."""
        text = Host.whole_report(tool, Host.line_path(), Host.raw_level())
        return text if tool in ("model", "misconfiguration") else Host.cut_report(text)

    @staticmethod
    def cut_report(text: Column) -> Column:
        return F.when(F.col("l_linenumber") == 7, F.substr(text, F.lit(1), F.lit(20))).otherwise(text)

    @staticmethod
    def whole_report(tool: str, path: Column, level: Column) -> Column:
        line, name, brand, kind = F.col("l_linenumber"), F.col("p_name"), F.col("p_brand"), F.col("p_type")

        def listed(field: str, record: Column) -> Column:
            return F.to_json(F.struct(F.array(record).alias(field)))

        if tool == "semgrep":
            start = F.struct(line.alias("line")).alias("start")
            extra = F.struct(kind.alias("lines"), name.alias("message"), level.alias("severity")).alias("extra")
            text = listed("results", F.struct(brand.alias("check_id"), path.alias("path"), start, extra))
        elif tool == "bandit":
            text = listed(
                "results",
                F.struct(
                    brand.alias("test_id"),
                    path.alias("filename"),
                    line.alias("line_number"),
                    kind.alias("code"),
                    name.alias("issue_text"),
                    level.alias("issue_severity"),
                ),
            )
        elif tool == "brakeman":
            text = listed(
                "warnings",
                F.struct(
                    path.alias("file"),
                    line.alias("line"),
                    kind.alias("code"),
                    brand.alias("warning_type"),
                    name.alias("message"),
                    level.alias("confidence"),
                ),
            )
        elif tool == "njsscan":
            metadata = F.struct(F.when(F.col("l_linestatus") == "O", level).alias("severity")).alias("metadata")
            found = F.struct(line.alias("line"), kind.alias("lines"), name.alias("title"), metadata)
            files = F.create_map(path, F.struct(F.array(found).alias("findings")))
            text = F.to_json(files)
        elif tool == "gosec":
            text = listed(
                "Issues",
                F.struct(
                    path.alias("file"),
                    line.cast("string").alias("line"),
                    kind.alias("code"),
                    name.alias("details"),
                    level.alias("severity"),
                ),
            )
        elif tool == "cppcheck":
            text = F.format_string(
                '<?xml version="1.0"?><results version="2"><errors><error severity="%s" msg="%s">'
                '<location file="%s" line="%d"/><location file="other.c" line="1"/></error></errors></results>',
                level,
                name,
                path,
                line,
            )
        elif tool == "gitleaks":
            record = F.struct(
                path.alias("File"),
                line.alias("StartLine"),
                kind.alias("Secret"),
                name.alias("Description"),
                F.when(F.col("l_linestatus") == "O", level).alias("Severity"),
            )
            text = F.to_json(F.array(record))
        elif tool == "model":
            body = listed(
                "vulnerabilities",
                F.struct(
                    path.alias("file_path"),
                    line.alias("line_number"),
                    kind.alias("code_snippet"),
                    name.alias("description"),
                    (F.col("l_discount") * 10).alias("confidence"),
                    F.when(F.col("l_linestatus") == "O", level).alias("severity"),
                ),
            )
            fenced = F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))
            flag = F.col("l_returnflag")
            text = F.when(flag == "A", fenced).when(flag == "N", body).otherwise("Nothing to report.")
        elif tool == "misconfiguration":
            body = listed("misconfigurations", F.struct(line.alias("line_number"), name.alias("description")))
            text = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
        else:
            raise ValueError(tool)
        return text

    def reports(self, tool: str | None = None) -> DataFrame:
        """Raw reports of one tool about every line, or of each line's own tool.

        What the tools' reports share is spelled once, in a step of its own: a JVM never
        compiles methods as long as all of it makes one.
        """
        lines = self.report_lines()
        if tool is not None:
            name, text = F.lit(tool), self.report_text(tool)
        else:
            lines = lines.withColumns({"_tool": self.tool(), "_path": self.line_path(), "_level": self.raw_level()})
            name, text = F.col("_tool"), F.lit(None)
            for own in ("semgrep", "bandit", "gitleaks"):
                text = F.when(name == own, self.whole_report(own, F.col("_path"), F.col("_level"))).otherwise(text)
            text = self.cut_report(text)
        return lines.select(
            F.col("l_orderkey").alias("scan_id"),
            name.alias("tool"),
            F.concat(F.lit("reports/"), self.line_id()).alias("path"),
            text.alias("text"),
        )

    def quality_reports(self) -> DataFrame:
        """Raw quality reports spelled from lineitem: the line's number picks the tool; some are cut short."""
        n, flag = F.col("l_linenumber"), F.col("l_returnflag")
        facts = F.struct(F.col("l_extendedprice").alias("maintainability"), n.alias("cyclomatic"), F.col("l_quantity").cast("int").alias("sloc"))
        javascript = F.to_json(F.struct(F.struct(F.array(F.struct(facts.alias("complexity"))).alias("reports")).alias("summary")))
        methods = F.array(F.struct(F.col("l_quantity").alias("complexity")), F.struct(n.alias("complexity")))
        module = F.struct(F.lower("l_returnflag").alias("rating"), F.col("l_suppkey").alias("lines_of_code"), methods.alias("methods"))
        space = F.struct(F.struct(n.alias("loc"), F.col("l_suppkey").alias("lloc"), F.lit(2).alias("comments")).alias("metrics"))
        measured = F.struct(F.struct(F.col("l_quantity").alias("sum")).alias("cyclomatic"), F.struct(F.col("l_tax").alias("mi_original")).alias("mi"))
        rust = F.concat(F.to_json(F.struct(measured.alias("metrics"), F.array(space).alias("spaces"))), F.lit("\n{}\n"))
        cohesive = F.to_json(F.create_map(F.lit("a"), F.struct(n.alias("lcom4"), F.col("l_suppkey").alias("ic"))))
        texts = {
            1: ("javascript", javascript),
            2: ("ruby", F.to_json(F.struct(F.array(module).alias("analysed_modules")))),
            3: ("rust", rust),
            4: ("go", F.format_string("%d main f a.go:1:1\n%d main g a.go:9:1\n", n, F.col("l_suppkey"))),
            5: ("coverage", F.format_string('<coverage line-rate="%s"><packages/></coverage>', F.col("l_tax").cast("string"))),
            6: ("lint", F.to_json(F.array_repeat(F.struct(n), (F.col("l_partkey") % 9).cast("int")))),
            7: ("cohesion", cohesive),
        }
        tool, text = F.lit(None).cast("string"), F.lit(None).cast("string")
        for number, (name, document) in texts.items():
            tool, text = F.when(n == number, name).otherwise(tool), F.when(n == number, document).otherwise(text)
        unknown = (n == 7) & (flag == "N")
        cut = flag == "R"
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("scan_id"),
            F.when(F.col("l_suppkey") % 2 == 0, "Python").otherwise("JavaScript").alias("scanner"),
            F.when(unknown, "mystery").otherwise(tool).alias("tool"),
            F.when((n == 2) & (flag == "A"), " ").otherwise(F.concat(F.lit("src/"), self.line_id())).alias("path"),
            F.when(cut, F.substr(text, F.lit(1), F.lit(12))).otherwise(text).alias("text"),
        )

    def corpus_findings(self) -> DataFrame:
        """Findings about the files of a scan's checkout: some files are missing, some lines lie behind the end."""
        number = F.col("l_linenumber")
        return self.table("lineitem").select(
            self.line_id().alias("id"),
            F.col("l_orderkey").alias("scan_id"),
            F.concat(F.lit("src"), F.col("l_orderkey") % 20).alias("repo"),
            F.when(number != 7, F.concat(F.lit("f/"), F.floor(F.col("l_partkey") / 20))).alias("file_path"),
            F.when(number == 6, 0).otherwise(F.col("l_quantity").cast("int")).alias("line_number"),
            F.when(F.col("l_returnflag") == "A", "requires login").otherwise("x").alias("code_snippet"),
            F.concat(self.tool(), F.lit(": "), self.raw_level()).alias("description"),
        )

    def verdicts(self) -> DataFrame:
        return self.table("labels").select("doc_id", (F.col("quality") == 0).alias("false_positive"))

    def scanner_results(self) -> DataFrame:
        """Project-wide results per (repository, scanner); some scanners report nothing."""
        empty = F.col("l_linenumber") == 7
        return self.table("lineitem").select(
            (F.col("l_suppkey") % 20).alias("repo"),
            F.when(~empty, F.col("l_tax") * 100).alias("code_coverage"),
            F.when(~empty, F.col("l_quantity")).alias("coupling"),
            F.col("l_discount").alias("cohesion"),
            F.when(~empty, F.lit(1)).alias("tests_passing"),
            F.col("l_linenumber").alias("duplicated_lines"),
            F.col("l_quantity").cast("int").alias("linter_issues"),
        )

    def evidence(self) -> DataFrame:
        """Evidence about the first line of an order: one piece per turn of its conversation."""
        findings = self.table("lineitem").filter(F.col("l_linenumber") == 1)
        turns = self.table("conversations").withColumnRenamed("conv_id", "l_orderkey")
        return findings.join(turns, "l_orderkey").select(
            self.line_id().alias("finding_id"), F.concat("role", "turn").alias("type"), F.col("text").alias("content")
        )

    def diffs(self) -> DataFrame:
        """One unified diff per document: its lines are added, removed and kept in turn."""
        from auditlake.functions.lines import split_lines

        lines = split_lines(F.col("text"))
        body = F.transform(
            lines, lambda x, i: F.concat(F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" "), x)
        )
        path = F.concat_ws("/", "source", F.concat("doc_id", F.lit(".py")))
        header = F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n@@ -5,9 +5,9 @@ def f\n", path, path, path, path)
        return self.table("documents").select(
            F.col("doc_id").alias("commit_hash"), F.concat(header, F.array_join(body, "\n"), F.lit("\n")).alias("diff")
        )

    @staticmethod
    def webhook_events(events: DataFrame) -> DataFrame:
        """events as webhook calls: purchases are pushes, some without a hash, some of deleted branches."""
        repo = F.concat(F.lit("u/r"), "user_id")
        url = F.concat(F.lit("https://github.com/"), repo, F.lit(".git"))
        after = F.when(F.col("value") < 30, F.when(F.col("event_id") % 50 == 0, F.lit("0" * 40)).otherwise(F.sha1(F.col("event_id").cast("string"))))
        body = F.struct(F.struct(url.alias("clone_url"), repo.alias("full_name")).alias("repository"), after.alias("after"))
        return events.select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(F.col("event_type") == "purchase", "push").otherwise(F.col("event_type")).alias("event_type"),
            F.to_json(body).alias("body"),
        )

    @staticmethod
    def taken_requests(events: DataFrame, pushes: DataFrame) -> DataFrame:
        """Views as scan requests for the hash their repository was at; every fifth is for the push before."""
        url = F.concat(F.lit("https://github.com/u/r"), "user_id", F.lit(".git"))
        views = events.filter("event_type = 'view'").select(
            url.alias("url"), F.lit(None).cast("string").alias("commit_hash"), F.col("ts").cast("timestamp").alias("ts"), "event_id"
        )
        in_order = Window.partitionBy("url").orderBy("ts", "event_id")
        earlier = Window.partitionBy("url").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
        known = pushes.select(views.columns).withColumn("before", F.lag("commit_hash").over(in_order))
        at = F.max_by(F.struct("commit_hash", "before"), F.when(F.col("commit_hash").isNotNull(), F.struct("ts", "event_id")))
        seen = known.unionByName(views.withColumn("before", F.lit(None).cast("string"))).withColumn("at", at.over(earlier))
        named = F.when(F.col("event_id") % 5 == 0, F.col("at.before")).otherwise(F.col("at.commit_hash"))
        return seen.filter("commit_hash IS NULL").select("url", named.alias("commit_hash"), "ts").filter("commit_hash IS NOT NULL")

    def event_stream(self) -> DataFrame:
        schema = self.table("events").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(self.folder)

    def known_urls(self) -> DataFrame:
        return self.table("supplier").select(
            F.concat(F.lit("https://github.com/u/r"), "s_suppkey", F.lit(".git")).alias("url")
        )
