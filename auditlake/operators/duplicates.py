"""Duplicate code: runs of at least ``min_tokens`` equal tokens within a repository.

A line counts as duplicated when one of its tokens lies in a token window
(shingle) that occurs more than once. Comparing every window would shuffle about
one row per token, so windows are narrowed first, without losing any:

1. k-gram hashes of a file, k being half a window, are minimised over each
   window. Equal windows have equal minima, and neighbouring windows mostly share
   one, so a file has far fewer runs of minima than tokens.
2. Runs whose minimum occurs once in the repository cannot hold a shared window.
3. A run is hashed as a whole, over the chain of its k-grams. Where two runs are
   equal, all their windows are, and a run stays one row.
4. Only where a run shares its minimum but not its whole are single windows
   compared, with those of one run of each kind that has the same minimum. Only
   files of such runs are read and split into tokens again.

What is found are intervals of lines; their union per file is taken by gaps and
islands. Groups are only counted, never listed, so a window that fills a third of
a corpus is combined map-side; no pairs of files are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import shingles
from auditlake.operators.filters import might_hold
from auditlake.session import written

# What a token is; ``functions.shingles`` finds them within lines.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f]"


LINES = ["first_line", "last_line", "first_at", "last_at"]


def _texts(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", "content", F.xxhash64("repo").alias("_repo")).filter(F.col("repo").isNotNull())


def _types(files: DataFrame) -> str:
    return ", ".join(f"{name} {files.schema[name].dataType.simpleString()}" for name in ("repo", "path"))


def _runs(files: DataFrame, min_tokens: int) -> DataFrame:
    """(repo, path, weight, minimum, first, last, h1, lines): stretches of windows with one minimum.

    ``minimum`` covers the repository too; with ``h1`` it tells the content of a run, in 128 bits.
    A run whose minimum comes again in its file may repeat a window inside itself;
    it weighs 2, so it is compared in any case.
    """
    return _texts(files).mapInArrow(shingles.runs(min_tokens), f"{_types(files)}, {shingles.RUN}")


def _windows(files: DataFrame, runs: DataFrame, min_tokens: int) -> DataFrame:
    """(repo, path, h1, lines, h2) of every window of some runs; only their files are split into tokens."""
    wanted = runs.groupBy("repo", "path").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    file = [F.col(c).cast("string") for c in ("repo", "path")]
    needed = might_hold(runs.select(file))  # contents of other files do not move
    texts = _texts(files).filter(needed(*file)).join(wanted, ["repo", "path"])
    return texts.mapInArrow(shingles.windows(min_tokens), f"{_types(files)}, {shingles.WINDOW}")


def _intervals(files: DataFrame, min_tokens: int) -> DataFrame:
    """(repo, path, lines): lines of shared runs and shared windows, overlapping at will."""
    runs = written(_runs(files, min_tokens), "runs")
    shared = written(runs.groupBy("minimum").agg(F.sum("weight").alias("w")).filter("w > 1").select("minimum"), "shared")
    known = written(runs.join(shared, "minimum", "left_semi"), "shared-runs")
    place = ["repo", "path", "first", "last"]
    kinds = known.groupBy("minimum", "h1").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("kept"))
    kinds = written(kinds.filter("n > 1").drop("n"), "kinds")
    wholly = known.join(kinds, ["minimum", "h1"], "left_semi")
    alone = known.join(kinds, ["minimum", "h1"], "left_anti")
    one_each = kinds.join(alone.select("minimum").distinct(), "minimum", "left_semi").select("kept.*")
    windows = written(_windows(files, alone.select(*place).union(one_each), min_tokens), "windows")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    partly = windows.join(repeated, ["h1", "h2"], "left_semi")
    return wholly.select("repo", "path", *LINES).union(partly.select("repo", "path", *LINES))


def duplicated_ranges(files: DataFrame, min_tokens: int = 70) -> DataFrame:
    """(repo, path, first_line, last_line, lines): maximal ranges of duplicated lines of each file.

    ``lines`` counts those that hold a token; ranges that touch, blank lines aside, are one.
    """
    file = ["repo", "path"]
    found = _intervals(files, min_tokens).groupBy(*file, "first_line", "first_at").agg(F.max("last_line").alias("last_line"), F.max("last_at").alias("last_at"))
    before = Window.partitionBy(file).orderBy("first_at").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("first_at") > F.max("last_at").over(before) + 1, F.lit(True))
    island = F.sum(F.col("opens").cast("int")).over(Window.partitionBy(file).orderBy("first_at"))
    return (
        found.withColumn("opens", opens)
        .withColumn("island", island)
        .groupBy(*file, "island")
        .agg(
            F.min("first_line").alias("first_line"),
            F.max("last_line").alias("last_line"),
            (F.max("last_at") - F.min("first_at") + 1).cast("bigint").alias("lines"),
        )
        .drop("island")
    )


def duplicated_lines_by_file(files: DataFrame, min_tokens: int = 70) -> DataFrame:
    """(repo, path, content) -> files with duplicated lines and how many they have."""
    return duplicated_ranges(files, min_tokens).groupBy("repo", "path").agg(F.sum("lines").alias("duplicated_lines"))


def duplicated_lines(files: DataFrame, min_tokens: int = 70) -> DataFrame:
    return duplicated_ranges(files, min_tokens).groupBy("repo").agg(F.sum("lines").alias("duplicated_lines"))
