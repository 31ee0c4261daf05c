"""Scanner report dialects: each turns a report's text into an array of findings.

A dialect is a Column expression, so one pass over a table of raw reports parses
all tools: CASE picks the dialect per row and only that parser runs. Scalars are
read as strings and cast leniently; a document that cannot be decoded gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.binding import let
from auditlake.functions.text import fenced_json, strip
from auditlake.schemas import FINDING_IN

_BAD = "_corrupt_record string"


def _finding(
    file_path: Column | None,
    line: Column | None,
    snippet: Column | None,
    description: Column,
    severity: Column | None,
    confidence: Column | None = None,
    cve_id: Column | None = None,
) -> Column:
    values = [file_path, line, snippet, description, severity, confidence, cve_id]
    fields = [
        (F.lit(None) if value is None else value).try_cast(field.dataType).alias(field.name)
        for value, field in zip(values, FINDING_IN.fields)
    ]
    return F.struct(*fields)


def _entries(document: Column, field: str, record: str) -> Column:
    """The document's record array: empty when absent, NULL when undecodable."""

    def of(parsed: Column) -> Column:
        found = F.coalesce(parsed[field], F.array().cast(f"array<{record}>"))
        undecodable = parsed.isNull() | (parsed[field].isNull() & parsed["_corrupt_record"].isNotNull())
        return F.when(~undecodable, found)

    return let(F.from_json(document, f"{field} array<{record}>, {_BAD}"), of)


def _says(tool: str, message: Column, link: Column | None = None) -> Column:
    parts = [F.lit(f"{tool}: "), message]
    if link is not None:
        parts += [F.lit(" ("), link, F.lit(")")]
    return F.concat(*parts)


def semgrep(text: Column) -> Column:
    record = "struct<check_id:string,path:string,start:struct<line:string>,extra:struct<lines:string,message:string,severity:string>>"
    return F.transform(
        _entries(text, "results", record),
        lambda r: _finding(
            r["path"],
            r["start"]["line"],
            r["extra"]["lines"],
            _says("semgrep", r["extra"]["message"], F.concat(F.lit("https://semgrep.dev/r/"), r["check_id"])),
            r["extra"]["severity"],
        ),
    )


def bandit(text: Column) -> Column:
    record = "struct<test_id:string,filename:string,line_number:string,code:string,issue_text:string,issue_severity:string>"
    plugins = F.lit("https://bandit.readthedocs.io/en/latest/plugins/")
    return F.transform(
        _entries(text, "results", record),
        lambda r: _finding(
            r["filename"],
            r["line_number"],
            r["code"],
            _says("bandit", r["issue_text"], F.concat(plugins, r["test_id"], F.lit(".html"))),
            r["issue_severity"],
        ),
    )


def brakeman(text: Column) -> Column:
    record = "struct<file:string,line:string,code:string,warning_type:string,message:string,confidence:string>"
    return F.transform(
        _entries(text, "warnings", record),
        lambda r: _finding(
            r["file"],
            r["line"],
            r["code"],
            _says("brakeman", F.concat(r["warning_type"], F.lit(" - "), r["message"])),
            r["confidence"],
        ),
    )


def njsscan(text: Column) -> Column:
    """A map from file to its findings; values without findings are other sections."""
    body = "findings array<struct<line:string,lines:string,title:string,metadata:struct<severity:string>>>"

    def of_file(entry: Column) -> Column:
        found = F.coalesce(F.from_json(entry["value"], body)["findings"], F.array().cast(body.split(" ", 1)[1]))
        return F.transform(
            found,
            lambda r: _finding(
                entry["key"],
                r["line"],
                r["lines"],
                _says("njsscan", r["title"]),
                F.coalesce(r["metadata"]["severity"], F.lit("UNKNOWN")),
            ),
        )

    return F.flatten(F.transform(F.map_entries(F.from_json(text, "map<string,string>")), of_file))


def gosec(text: Column) -> Column:
    record = "struct<file:string,line:string,code:string,details:string,severity:string>"
    return F.transform(
        _entries(text, "Issues", record),
        lambda r: _finding(r["file"], r["line"], r["code"], _says("gosec", r["details"]), r["severity"]),
    )


def cppcheck(text: Column) -> Column:
    """XML: every error with its first location; errors sit in <errors> or, in old reports, at the root."""
    errors = "array<struct<_severity:string,_msg:string,location:array<struct<_file:string,_line:string>>>>"
    empty = F.array().cast(errors)

    def finding(r: Column) -> Column:
        at = F.get(r["location"], F.lit(0))
        return _finding(at["_file"], at["_line"], F.lit(""), _says("cppcheck", r["_msg"]), F.upper(r["_severity"]))

    def of(parsed: Column) -> Column:
        found = F.concat(F.coalesce(parsed["errors"]["error"], empty), F.coalesce(parsed["error"], empty))
        decoded = parsed.isNotNull() & parsed["_corrupt_record"].isNull()
        return F.when(decoded, F.transform(found, finding))

    return let(F.from_xml(text, F.lit(f"errors struct<error:{errors}>, error {errors}, {_BAD}")), of)


def gitleaks(text: Column) -> Column:
    record = "array<struct<File:string,StartLine:string,Secret:string,Description:string,Severity:string>>"
    is_array = F.startswith(strip(text), F.lit("["))
    return F.when(
        is_array,
        F.transform(
            F.from_json(text, record),
            lambda r: _finding(
                r["File"],
                r["StartLine"],
                r["Secret"],
                _says("Gitleaks", r["Description"]),
                F.coalesce(r["Severity"], F.lit("HIGH")),
            ),
        ),
    )


def model(text: Column, threshold: float = 0.7) -> Column:
    """A model's answer, fenced or bare; findings below the confidence threshold are not reported."""
    record = (
        "struct<file_path:string,line_number:string,code_snippet:string,description:string,"
        "confidence:string,severity:string>"
    )
    found = F.transform(
        _entries(fenced_json(text), "vulnerabilities", record),
        lambda r: _finding(
            r["file_path"],
            r["line_number"],
            r["code_snippet"],
            r["description"],
            F.coalesce(r["severity"], F.lit("UNKNOWN")),
            F.coalesce(r["confidence"].try_cast("double"), F.lit(0.0)),
        ),
    )
    return F.filter(found, lambda f: f["confidence_score"] >= threshold)


def misconfiguration(text: Column, config_path: Column) -> Column:
    """A model's answer about one configuration file; such findings have no severity."""
    return F.transform(
        _entries(fenced_json(text), "misconfigurations", "struct<line_number:string,description:string>"),
        lambda r: _finding(config_path, r["line_number"], None, r["description"], None),
    )


DIALECTS = {
    "semgrep": semgrep,
    "bandit": bandit,
    "brakeman": brakeman,
    "njsscan": njsscan,
    "gosec": gosec,
    "cppcheck": cppcheck,
    "gitleaks": gitleaks,
    "model": model,
}


def parse_reports(reports: DataFrame) -> DataFrame:
    """(scan_id, tool, path, text) -> one row per finding, plus one per empty or rejected report.

    ``position`` is the finding's place in its report and NULL on reports that
    give none; ``reject_reason`` says why. The outer explode keeps the parser
    below the generator, so each document is decoded once.
    """
    tool, text = F.col("tool"), F.col("text")
    items = F.when(tool == "misconfiguration", misconfiguration(text, F.col("path")))
    for name, dialect in DIALECTS.items():
        items = items.when(tool == name, dialect(text))
    known = tool.isin(["misconfiguration", *DIALECTS])
    reason = F.when(~known, "unknown tool").when(F.col("items").isNull(), "undecodable")
    return (
        reports.withColumn("items", items)
        .select(
            "scan_id",
            "tool",
            F.col("path").alias("report_path"),
            reason.alias("reject_reason"),
            F.posexplode_outer("items").alias("position", "item"),
        )
        .select("scan_id", "tool", "report_path", "position", "reject_reason", "item.*")
    )


def reported_findings(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("position").isNotNull()).drop("reject_reason")


def rejected_reports(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull()).select("scan_id", "tool", "report_path", "reject_reason")


def advisories(reports: DataFrame) -> DataFrame:
    """Advisory scan output: one row per package and advisory; undecodable text gives none."""
    record = "struct<package:struct<name:string,version:string>,vulns:array<struct<id:string,summary:string,details:string>>>"
    kept = [c for c in reports.columns if c != "text"]
    return (
        reports.select(*kept, F.explode_outer(_entries(F.col("text"), "results", record)).alias("r"))
        .select(*kept, F.col("r.package").alias("p"), F.explode_outer("r.vulns").alias("v"))
        .filter(F.col("v").isNotNull())
        .select(
            *kept,
            F.col("v.id").alias("advisory_id"),
            F.col("p.name").alias("package"),
            F.col("p.version").alias("version"),
            F.coalesce("v.summary", F.lit("No summary available.")).alias("summary"),
            F.coalesce("v.details", F.lit("No details available.")).alias("details"),
        )
    )
