"""Quality tool outputs as struct-valued Columns; whatever is missing or broken counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.binding import let
from auditlake.functions.text import strip

# Maintainability score of a letter rating.
RATINGS = {"A": 100, "B": 80, "C": 60, "D": 40, "E": 20, "F": 0}


def _zero(value: Column, kind: str) -> Column:
    return F.coalesce(value.try_cast(kind), F.lit(0).cast(kind))


def _total(values: Column, kind: str) -> Column:
    zero = F.lit(0).cast(kind)
    return F.coalesce(F.aggregate(values, zero, lambda a, x: a + F.coalesce(x.try_cast(kind), zero)), zero)


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def javascript(text: Column) -> Column:
    schema = (
        "summary struct<reports:array<struct<complexity:struct<maintainability:string,cyclomatic:string,sloc:string>>>>"
    )
    return let(
        _first(F.from_json(text, schema)["summary"]["reports"])["complexity"],
        lambda facts: F.struct(
            _zero(facts["maintainability"], "double").alias("maintainability_index"),
            _zero(facts["cyclomatic"], "int").alias("cyclomatic_complexity"),
            _zero(facts["sloc"], "int").alias("sloc"),
        ),
    )


def ruby(text: Column) -> Column:
    schema = "analysed_modules array<struct<rating:string,lines_of_code:string,methods:array<struct<complexity:string>>>>"
    scores = F.create_map(*[F.lit(x) for pair in RATINGS.items() for x in pair])
    return let(
        _first(F.from_json(text, schema)["analysed_modules"]),
        lambda module: F.struct(
            _zero(F.try_element_at(scores, F.upper(module["rating"])), "double").alias("maintainability_index"),
            _total(module["methods"]["complexity"], "double").alias("cyclomatic_complexity"),
            _zero(module["lines_of_code"], "int").alias("sloc"),
        ),
    )


def rust(text: Column) -> Column:
    """One JSON document per line, the first one counts; an empty space list voids the report."""
    schema = (
        "metrics struct<cyclomatic:struct<sum:string>,mi:struct<mi_original:string>>,"
        "spaces array<struct<metrics:struct<loc:string,lloc:string,comments:string>>>"
    )

    def of(report: Column) -> Column:
        counts = ~F.coalesce(F.size(report["spaces"]) == 0, F.lit(False))

        def kept(value: Column, kind: str) -> Column:
            return _zero(F.when(counts, value), kind)

        space = _first(report["spaces"])["metrics"]
        return F.struct(
            kept(report["metrics"]["mi"]["mi_original"], "double").alias("maintainability_index"),
            kept(report["metrics"]["cyclomatic"]["sum"], "double").alias("cyclomatic_complexity"),
            kept(space["loc"], "int").alias("sloc"),
            kept(space["lloc"], "int").alias("lloc"),
            kept(space["comments"], "int").alias("comments"),
        )

    return let(F.from_json(F.substring_index(strip(text), "\n", 1), schema), of)


def go_complexity(text: Column) -> Column:
    """Sum of the integers that open the output's lines."""
    return _total(F.regexp_extract_all(strip(text), F.lit(r"(?dm)^(\d+)"), F.lit(1)), "bigint")


def coverage_percent(text: Column) -> Column:
    return _zero(F.from_xml(text, F.lit("`_line-rate` string"))["_line-rate"], "double") * 100


def duplicated_lines(text: Column) -> Column:
    return _total(F.regexp_extract_all(text, F.lit(r"Found a (\d+) line duplication"), F.lit(1)), "bigint")


def lint_issues(text: Column) -> Column:
    """Length of the array; its records are decoded only where a count of tokens can't tell.

    Both readers take the same arrays, but for control characters within strings and
    numbers like NaN; a text that opens with a plain character other than ``[`` is none.
    """
    decoded = F.size(F.from_json(text, "array<string>"))
    counted = F.when(~text.rlike(r"[\x00-\x1f]"), F.json_array_length(text))
    other = strip(text).rlike(r"\A[!-Z\\\]-~]")
    return F.when(other, 0).otherwise(F.greatest(F.coalesce(counted, decoded, F.lit(0)), F.lit(0)))


def cohesion(text: Column) -> Column:
    def of(modules: Column) -> Column:
        n = F.size(modules)

        def mean(values: Column) -> Column:
            return F.when(n > 0, _total(values, "double") / n).otherwise(0.0)

        return F.struct(mean(modules["ic"]).alias("coupling"), mean(modules["lcom4"]).alias("cohesion"))

    return let(F.map_values(F.from_json(text, "map<string,struct<lcom4:string,ic:string>>")), of)
