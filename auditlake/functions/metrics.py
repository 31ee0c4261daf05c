"""Code metrics of one file's text as Columns; no shuffle, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.lines import line_count

# Words and signs that open a branch, per language.
_C_LIKE = ["if", "for", "while", "case", "catch"]
BRANCH_WORDS = {
    "Python": ["if", "elif", "for", "while", "except", "and", "or", "assert", "case"],
    "Ruby": ["if", "elsif", "unless", "for", "while", "until", "when", "rescue", "and", "or"],
    "Rust": ["if", "for", "while", "loop", "match"],
    "Go": ["if", "for", "case", "select"],
    **{language: _C_LIKE for language in ("JavaScript", "TypeScript", "C", "C++", "Java", "PHP")},
}
ANY_BRANCH_WORDS = ["if", "elif", "for", "while", "case", "catch", "except", "and", "or"]
BRANCH_SIGNS = r"&&|\|\|"
# What opens a comment line, per language.
COMMENT_OPENERS = {
    **{language: "#" for language in ("Python", "Ruby", "Shell")},
    **{language: "//" for language in ("JavaScript", "TypeScript", "Go", "Rust", "C", "C++", "Java")},
}
ANY_COMMENT_OPENER = "#|//"

OPERATORS = "-+*/%=<>!&|^~?:.,;(){}[]"
OPERAND = r"[A-Za-z0-9_]+"


def _per_language(language: Column, patterns: dict[str, str], default: str, count) -> Column:
    """CASE over the distinct patterns, so each row runs one regex."""
    by_pattern: dict[str, list[str]] = {}
    for name, pattern in patterns.items():
        by_pattern.setdefault(pattern, []).append(name)
    result = F.when(F.lit(False), F.lit(0))
    for pattern, names in by_pattern.items():
        result = result.when(language.isin(names), count(pattern))
    return result.otherwise(count(default))


def blank_lines(content: Column) -> Column:
    return F.when(content == "", 0).otherwise(F.regexp_count(content, F.lit(r"(?dm)^[ \t\r\f]*$")))


def comment_lines(content: Column, language: Column) -> Column:
    return _per_language(
        language,
        COMMENT_OPENERS,
        ANY_COMMENT_OPENER,
        lambda opener: F.regexp_count(content, F.lit(rf"(?dm)^[ \t]*({opener})")),
    )


def cyclomatic_complexity(content: Column, language: Column) -> Column:
    """Branch words and signs of the language, plus one."""

    def pattern(words: list[str]) -> str:
        return rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])|{BRANCH_SIGNS}"

    patterns = {name: pattern(words) for name, words in BRANCH_WORDS.items()}
    count = _per_language(
        language, patterns, pattern(ANY_BRANCH_WORDS), lambda regex: F.regexp_count(content, F.lit(regex))
    )
    return count + 1


def halstead_volume(content: Column) -> Column:
    """Token count times the bits a token of the file's vocabulary takes.

    Operators are single characters, so they are counted by length and presence;
    only operands are extracted.
    """
    operands = F.regexp_extract_all(content, F.lit(OPERAND), F.lit(0))
    operators = F.length(content) - F.length(F.translate(content, OPERATORS, ""))
    kinds = [F.contains(content, F.lit(sign)).cast("int") for sign in OPERATORS]
    vocabulary = reduce(lambda a, b: a + b, kinds) + F.size(F.array_distinct(operands))
    length = operators + F.size(operands)
    # No CASE: an empty text has length 0, and unconditional parts are worked out once.
    return length * F.log2(F.greatest(vocabulary, F.lit(1)).cast("double"))


def maintainability_index(volume: Column, complexity: Column, sloc: Column, comments: Column) -> Column:
    """The published index on 0..100, with its comment weight; trivial files score 100."""
    weight = F.sqrt(2.46 * F.radians(100.0 * comments / sloc))
    raw = 171 - 5.2 * F.ln(volume) - 0.23 * complexity - 16.2 * F.ln(sloc.cast("double")) + 50 * F.sin(weight)
    bounded = F.least(F.greatest(raw * 100 / 171, F.lit(0.0)), F.lit(100.0))
    return F.when((volume > 0) & (sloc > 0), bounded).otherwise(100.0)


def file_metrics(content: Column, language: Column) -> dict[str, Column]:
    """Line facts and complexity; further metrics build on these columns."""
    total, blank, comments = line_count(content), blank_lines(content), comment_lines(content, language)
    return {
        "lines": total,
        "blank": blank,
        "comments": comments,
        "sloc": total - blank - comments,
        "cyclomatic_complexity": cyclomatic_complexity(content, language),
        "halstead_volume": halstead_volume(content),
    }
