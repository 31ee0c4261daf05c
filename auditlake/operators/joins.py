"""Validation and enrichment joins of findings.

No join is hinted: Spark broadcasts a side only when its measured size is under
the session's threshold, and AQE splits skewed partitions otherwise. Rows that
cannot match get a key of their own, so they do not meet in one NULL partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.lines import NEWLINE, around_line, line_count
from auditlake.operators.filters import might_hold

# Fixed value: the snippet a rule scanner reports when it withholds the code.
WITHHELD = "requires login"
BLOCK = 1_000  # advisories of a package that a scan meets at once, about
FINDING = ["scan_id", "cve_id", "description"]  # what tells an advisory's findings apart


def spread_key(key: Column, applies: Column, row_id: Column) -> Column:
    """``key`` where it applies, else a never-matching key that is unique to the row."""
    return F.when(applies & key.isNotNull(), key).otherwise(F.concat(F.lit("\u0000"), row_id))


def check_source(findings: DataFrame, files: DataFrame, checkout: str = "scan_id") -> DataFrame:
    """Add ``reject_reason``: the file is missing, or the line lies behind its end.

    ``checkout`` names the column of both sides that tells whose tree a path is in:
    a scan or a repository. Pathless findings pass, and so do lines of 0 or NULL and
    files without readable content. Each finding stays one row, also where a file
    is listed twice. Only (checkout, path, line count) of the files is shuffled.
    """
    path, line = F.col("file_path"), F.col("line_number")
    has_path = F.coalesce(path != "", F.lit(False))
    known = (
        files.select(checkout, F.col("path").alias("_key"), line_count(F.col("content")).alias("_n"))
        .groupBy(checkout, "_key")
        .agg(F.lit(True).alias("_present"), F.max("_n").alias("_lines"))
    )
    reason = F.when(has_path & F.col("_present").isNull(), "file not found").when(
        has_path & (line != 0) & (line > F.col("_lines")), "line out of bounds"
    )
    return (
        findings.withColumn("_key", spread_key(path, has_path, F.col("id")))
        .join(known, [checkout, "_key"], "left")
        .withColumn("reject_reason", reason)
        .drop("_key", "_present", "_lines")
    )


def fill_snippets(findings: DataFrame, files: DataFrame, checkout: str = "scan_id") -> DataFrame:
    """Replace withheld snippets by the seven lines around the finding, within its own checkout.

    Contents of other files are left out by a run-time filter where they are read,
    so they never move. Each file that is needed meets its distinct line numbers
    once and is split once, so neither many findings in a file nor in a line repeat
    its content; findings with a snippet of their own take no part in a join.
    Rejected findings are left alone: the line numbers of the others are within the
    file.
    """
    snippet = F.col("code_snippet")
    withheld = F.coalesce(snippet == WITHHELD, F.lit(False)) & F.col("line_number").isNotNull()
    if "reject_reason" in findings.columns:
        withheld = withheld & F.col("reject_reason").isNull()
    wanted = findings.filter(withheld)
    file = [checkout, "file_path"]
    numbers = wanted.groupBy(file).agg(F.collect_set("line_number").alias("_numbers"))
    named = [F.col(c).cast("string") for c in file]
    needed = might_hold(wanted.select(named))
    contents = files.select(checkout, F.col("path").alias("file_path"), "content").filter(needed(*named))
    once = contents.join(numbers.select(file), file, "left_semi").groupBy(file).agg(F.max("content").alias("content"))
    pieces = once.select(*file, F.split("content", NEWLINE, -1).alias("_pieces"))
    around = F.transform(
        "_numbers", lambda n: F.struct(n.alias("line_number"), around_line(F.col("_pieces"), n).alias("_text"))
    )
    texts = (
        numbers.join(pieces, file).select(*file, F.explode(around).alias("_a")).select(*file, "_a.*")
    )
    filled = (
        wanted.join(texts, [*file, "line_number"], "left")
        .withColumn("code_snippet", F.coalesce("_text", snippet))
        .select(findings.columns)
    )
    return findings.filter(~withheld).unionByName(filled)


def suppress(findings: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Drop findings with a positive false-positive verdict; no or a broken verdict keeps them.

    NULLs compare equal: a finding without a snippet has its verdict under NULL.
    """
    positive = verdicts.filter(F.col("false_positive")).select([F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return findings.join(positive, same, "left_anti")


def match_advisories(dependencies: DataFrame, advisories: DataFrame, told: bool = False) -> DataFrame:
    """Advisories of each scan's packages: by version where one is known, else by package.

    Dependencies are deduplicated first (it combines map-side), so a package that
    fills a third of the table joins once per scan and version. They meet the
    advisories in lists of about ``BLOCK``, so a join has a row per list and not one
    per pair; a package without version meets the lists of its package one by one,
    so that the pairs of one package are made by many tasks.

    ``told`` leaves the matches in these lists, ``matched``, each of one severity, and
    adds two marks from which ``advisory_findings`` knows what is no repeat without
    comparing matches: ``repeats`` says that the advisories of a list are known in
    several versions, packages or wordings, ``given`` that the scan has the package
    without version too, which matches the same advisories.
    """
    wanted = dependencies.select("scan_id", "package", "version").distinct()
    of_version, of_package = [advisories.groupBy(k).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks")) for k in (["package", "version"], ["package"])]
    marks = []
    if told:
        place = F.struct("package", "version", "summary")
        repeated = advisories.groupBy("advisory_id").agg((~F.min(place).eqNullSafe(F.max(place))).alias("repeats"))
        advisories = advisories.join(repeated, "advisory_id", "left").withColumn("repeats", F.coalesce("repeats", F.lit(True)))
        versionless_too = F.max(F.col("version").isNull()).over(Window.partitionBy("scan_id", "package"))
        wanted = wanted.withColumn("given", versionless_too & F.col("version").isNotNull())
        marks = [c for c in advisories.columns if c in ("repeats", "severity")]
    block = F.pmod(F.xxhash64("advisory_id"), F.col("_blocks")).alias("_block")
    listed = F.collect_list(F.struct(*[c for c in advisories.columns if c not in ("package", "version", *marks)])).alias("matched")
    exact = advisories.dropDuplicates(["package", "version", "advisory_id"]).join(of_version, ["package", "version"])
    lists = exact.groupBy("package", "version", block, *marks).agg(listed).drop("_block")
    versioned = wanted.filter(F.col("version").isNotNull()).join(lists, ["package", "version"])
    # the pairs are many where the rows are few; Spark drops a repartition() that is no other than the grouping's
    parts = 2 * int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = advisories.dropDuplicates(["package", "advisory_id"]).join(of_package, "package")
    blocks = known.groupBy("package", block, *marks).agg(listed).repartition(parts, "package", "_block")
    versionless = (
        wanted.filter(F.col("version").isNull())
        .join(of_package, "package")
        .select(*wanted.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block"))
        .repartition(parts, "package", "_block")
        .join(blocks, ["package", "_block"])
    )
    columns = [*wanted.columns, *marks, "matched"] if told else ["package", "version", "scan_id", F.inline("matched")]
    return versioned.select(columns).unionByName(versionless.select(columns))


def advisory_findings(matches: DataFrame, listed: bool = False) -> DataFrame:
    """Matched advisories as findings: no path, no line, tool severity UNKNOWN unless given.

    Matches in the lists of ``match_advisories`` are deduplicated by their marks:
    only those of repeated advisories are compared, and the findings have ``once``,
    as none of them comes again. ``listed`` leaves them in their lists: a row has a
    scan, a severity and the advisories ``matched`` by the findings it stands for.
    """
    severity = (F.col("severity") if "severity" in matches.columns else F.lit("UNKNOWN")).alias("severity")
    columns = ["scan_id", F.col("summary").alias("description"), severity, F.col("advisory_id").alias("cve_id")]
    if "matched" not in matches.columns:
        return matches.select(columns).dropDuplicates(FINDING)
    single = matches.filter(~F.col("repeats") & ~F.col("given")).select("scan_id", severity, "matched")
    several = matches.filter("repeats").select("scan_id", severity, F.inline("matched")).select(columns).dropDuplicates(FINDING)
    if listed:
        alone = F.array(F.struct(F.col("cve_id").alias("advisory_id"), F.col("description").alias("summary")))
        shown = F.transform("matched", lambda a: F.struct(a["advisory_id"].alias("advisory_id"), a["summary"].alias("summary")))
        single = single if single.schema["matched"].dataType.elementType.names == ["advisory_id", "summary"] else single.withColumn("matched", shown)
        found = single.unionByName(several.select("scan_id", "severity", alone.alias("matched")))
    else:
        found = single.select("scan_id", "severity", F.inline("matched")).select(columns).unionByName(several)
    return found.withColumn("once", F.lit(True))


def link_cves(findings: DataFrame, advisories: DataFrame) -> DataFrame:
    """Give findings without a CVE their package's advisory when it has exactly one, in however many versions."""
    only = (
        advisories.groupBy("package")
        .agg(F.min("advisory_id").alias("_only"), F.max("advisory_id").alias("_last"))
        .filter(F.col("_only") == F.col("_last"))
        .select(F.col("package").alias("_key"), "_only")
    )
    key = spread_key(F.col("package"), F.col("cve_id").isNull(), F.col("id"))
    return (
        findings.withColumn("_key", key)
        .join(only, "_key", "left")
        .withColumn("cve_id", F.coalesce("cve_id", "_only"))
        .drop("_key", "_only")
    )


def unreported(findings: DataFrame, existing: DataFrame) -> DataFrame:
    """Findings not yet known for the same scan, file, line and description; NULLs compare equal."""
    keys = ["scan_id", "file_path", "line_number", "description"]
    known = existing.select([F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return findings.join(known, same, "left_anti")


def deep_scan_findings(analyses: dict[str, DataFrame]) -> DataFrame:
    """Bag union of all analysers' findings with their tool's name.

    The advisory step runs twice in a deep scan; its findings are kept once. Those
    marked ``once`` are known not to come again in what both runs gave together.
    Findings in the lists of ``advisory_findings`` stay in them: ``n`` then tells how
    many findings each row of the union stands for.
    """
    parts = [df.withColumn("tool", F.lit(tool)) for tool, df in analyses.items() if tool != "advisory"]
    if "advisory" in analyses:
        found = analyses["advisory"]
        if "matched" in found.columns:
            parts = [part.withColumn("n", F.lit(1)) for part in parts]
            once = found.drop("once").withColumn("n", F.size("matched"))
        elif "once" in found.columns:
            known = F.coalesce("once", F.lit(False))
            once = found.filter(known).unionByName(found.filter(~known).dropDuplicates(FINDING)).drop("once")
        else:
            once = found.dropDuplicates(FINDING)
        parts.append(once.withColumn("tool", F.lit("advisory")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union
