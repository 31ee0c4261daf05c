"""Reading the findings store and file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.paths import base_name, relative_path
from auditlake.schemas import STORE


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One store table below ``root`` with its fixed schema; no inference, no listing of others."""
    return spark.read.schema(STORE[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_jdbc_table(
    spark: SparkSession, url: str, name: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A table of an existing relational store, read in parallel ranges of its numeric id."""
    if name not in STORE:
        raise ValueError(f"unknown table {name}")
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn="id", **options)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def file_inventory(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    """Every file below ``root``: path relative to it, its first folder as ``repo``, name, length, content.

    ``content`` is read only by plans that use it, so path predicates come free.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    full = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    path = relative_path(full, root)
    repo = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1))
    return reader.load(root).select(
        path.alias("path"), repo.alias("repo"), base_name(path).alias("name"), "length", "content"
    )


def text_files(inventory: DataFrame) -> DataFrame:
    """Inventory with decoded text; bytes that are no UTF-8 are replaced, never dropped."""
    return inventory.withColumn("content", F.col("content").cast("string"))


def report_files(spark: SparkSession, root: str) -> DataFrame:
    """Raw reports laid out as ``<root>/scan_id=<id>/tool=<tool>/<file>``, one row per file."""
    return (
        spark.read.schema("text string, scan_id bigint, tool string")
        .text(root, wholetext=True)
        .withColumn("path", F.col("_metadata.file_path"))
        .select("scan_id", "tool", "path", F.col("text"))
    )
