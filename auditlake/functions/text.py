"""Text and URL columns: descriptions, model answers, logs, repository URLs, ref listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without ASCII white space at either end; linear in the text, unlike a pattern for both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """regexp_extract that yields NULL, not '', where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def description_url(description: Column) -> Column:
    return first_match(F.translate(description, "()", ""), r"https?://\S+")


def description_text(description: Column) -> Column:
    """Description without its parenthesised link."""
    url = description_url(description)
    linked = F.concat(F.lit("("), url, F.lit(")"))
    return F.when(url.isNull(), description).otherwise(strip(F.replace(description, linked, F.lit(""))))


def rule_id(description: Column) -> Column:
    url = description_url(description)
    last = F.substring_index(url, "/", -1)
    return (
        F.when(F.contains(url, F.lit("semgrep.dev")), last)
        .when(F.contains(url, F.lit("bandit.readthedocs.io")), F.replace(last, F.lit(".html"), F.lit("")))
        .when(url.isNotNull(), "doc")
    )


def like_escaped(text: str) -> str:
    """A user-typed word as a LIKE fragment that matches itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def from_scanner(description: Column, scanner: str) -> Column:
    """Findings of one tool: its name and a colon open the description, in any case."""
    return description.ilike(like_escaped(scanner) + ":%")


def has_keyword(description: Column, keyword: str) -> Column:
    return description.ilike(f"%{like_escaped(keyword)}%")


def fenced_json(text: Column) -> Column:
    """First fenced JSON block, else the text itself when it opens an object, else '{}'."""
    # Fixed value: how an answer marks its JSON block.
    fenced = first_match(text, r"(?s)```json\n(.*?)\n```", 1)
    bare = strip(text)
    return F.coalesce(strip(fenced), F.when(F.startswith(bare, F.lit("{")), bare), F.lit("{}"))


def strict_log_verdict(log: Column) -> Column:
    """A test log passes only if neither 'failed' nor 'error' occurs anywhere in it."""
    low = F.lower(log)
    return ~F.contains(low, F.lit("failed")) & ~F.contains(low, F.lit("error"))


# Accepted forms of a repository page, most specific first.
REPOSITORY_PAGES = [
    r"^https?://github\.com/([\w.-]+)/([\w.-]+)/tree/([\w./-]+)",
    r"^https?://github\.com/([\w.-]+)/([\w.-]+)\.git",
    r"^https?://github\.com/([\w.-]+)/([\w.-]+)",
]


def clone_url(url: Column) -> Column:
    """Base ``.git`` URL of a repository page, NULL for anything else."""
    found = [
        F.when(
            url.rlike(page),
            F.concat(
                F.lit("https://github.com/"),
                F.regexp_extract(url, page, 1),
                F.lit("/"),
                F.regexp_extract(url, page, 2),
                F.lit(".git"),
            ),
        )
        for page in REPOSITORY_PAGES
    ]
    return F.coalesce(*found)


def url_branch(url: Column) -> Column:
    return first_match(url, REPOSITORY_PAGES[0], 3)


def repository_name(url: Column) -> Column:
    return F.replace(F.substring_index(url, "/", -1), F.lit(".git"), F.lit(""))


def push_url(url: Column) -> Column:
    """URL to push to: known hosts get their ``.git`` suffix, unknown ones NULL."""
    # Fixed value: hosts whose pages are also clone addresses.
    hosted = url.rlike(r"^https://(github\.com|bitbucket\.org)/[\w-]+/[\w-]+")
    return F.when(F.endswith(url, F.lit(".git")), url).when(hosted, F.concat(url, F.lit(".git")))


def branch_of_ref(line: Column) -> Column:
    return F.substring_index(line, "refs/heads/", -1)


def primary_branch(listing: Column) -> Column:
    # Fixed value: the head line of a remote listing.
    return first_match(listing, r"ref: refs/heads/(\S+)\s+HEAD", 1)


def first_hash(listing: Column) -> Column:
    return first_match(listing, r"\S+")


def half_up(value: Column, digits: int) -> Column:
    """Round half up on the decimal value, as every engine does it for decimals."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")
