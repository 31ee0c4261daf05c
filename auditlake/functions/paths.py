"""Path predicates and the language of a path, all as built-in Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes per language.
SUFFIXES = {
    "Python": [".py", ".pyw"],
    "JavaScript": [".js", ".mjs", ".cjs"],
    "TypeScript": [".ts", ".tsx"],
    "Go": [".go"],
    "Ruby": [".rb"],
    "Rust": [".rs"],
    "C": [".c", ".h"],
    "C++": [".cpp", ".hpp", ".cc", ".hh"],
    "Shell": [".sh"],
    "HTML": [".html", ".htm"],
    "Java": [".java"],
    "PHP": [".php"],
}
# Whole file names that decide the language by themselves.
FILE_NAMES = {"package.json": "Node.js", "Gemfile": "Ruby", "Cargo.toml": "Rust"}

# Files and folders that are no source code.
SKIPPED_NAMES = [".gitignore", "semgrep-report.json", "bandit-report.json", "LICENSE"]
SKIPPED_SUFFIXES = [".db", ".sqlite3", ".log", ".pyc", ".egg-info", ".DS_Store", ".md", ".txt", ".rst", ".yml"]
SKIPPED_FOLDERS = ["__pycache__", ".git", ".venv", ".venv2", "node_modules", "build", "dist"]
TEST_FOLDERS = ["tests", "test"]

# Configuration files.
CONFIG_NAMES = [
    "Dockerfile",
    "docker-compose.yml",
    "docker-compose.yaml",
    "kubernetes.yaml",
    "kubernetes.yml",
    "deployment.yml",
    "deployment.yaml",
    "values.yaml",
    "values.yml",
    "Chart.yaml",
    "package.json",
    "Gemfile",
    "Cargo.toml",
    "Makefile",
    "CMakeLists.txt",
    "nginx.conf",
    "httpd.conf",
]
CONFIG_SUFFIXES = [".yml", ".yaml", ".json", ".toml", ".ini", ".conf", ".tf"]

# Patterns excluded from every rule scan.
GLOBAL_EXCLUSIONS = [".gitignore", "*.md"]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Last suffix with its dot; leading dots of a name start no suffix."""
    name = base_name(path)
    has_suffix = F.contains(F.ltrim(name, F.lit(".")), F.lit("."))
    return F.when(has_suffix, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def language_of_path(path: Column) -> Column:
    """Language by whole file name, then by case-sensitive last suffix, else NULL.

    A constant map keeps name and suffix from being worked out once per language.
    """
    pairs = {suffix: language for language, suffixes in SUFFIXES.items() for suffix in suffixes} | FILE_NAMES
    languages = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(languages, base_name(path)), F.try_element_at(languages, file_suffix(path)))


def relative_path(path: Column, root: Column | str) -> Column:
    """Path below ``root`` when it lies there, unchanged otherwise."""
    root = F.lit(root) if isinstance(root, str) else root
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def below_folder(path: Column, folders: list[str]) -> Column:
    """True when any folder on the way to the file carries one of the names."""
    names = "|".join(map(re.escape, folders))
    return path.rlike(f"(^|/)({names})/")


def in_scan_tree(path: Column, include_tests: bool = False) -> Column:
    """Files a rule scan walks over: everything outside skipped folders."""
    return ~below_folder(path, SKIPPED_FOLDERS + ([] if include_tests else TEST_FOLDERS))


def is_source_file(path: Column, include_tests: bool = False) -> Column:
    ends = "|".join(map(re.escape, SKIPPED_SUFFIXES))
    return (
        in_scan_tree(path, include_tests)
        & ~base_name(path).isin(SKIPPED_NAMES)
        & ~base_name(path).rlike(f"({ends})$")
    )


def is_config_file(path: Column) -> Column:
    ends = "|".join(map(re.escape, CONFIG_SUFFIXES))
    name = base_name(path)
    return name.isin(CONFIG_NAMES) | name.rlike(f"({ends})$")


def is_test_path(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("test"))


def exclusion_regex(pattern: Column) -> Column:
    """Glob -> regex over a '/'-led path: it may match any folder or file on the way."""
    quoted = F.regexp_replace(F.trim(pattern), r"([.+^$(){}|\[\]\\])", r"\\$1")
    body = F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("/"), body, F.lit("(/|$)"))
