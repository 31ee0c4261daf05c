"""Ordered lists per key that stay bounded however large a key's group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import written


def ordered_lists(df: DataFrame, keys: list[str], order: list[str], item: Column, limit: int = 10_000) -> DataFrame:
    """(keys, segment, items): each group's items in order, ``limit`` per row but for the last.

    Rows are sorted globally on (keys, order), which range-partitions one group over
    many tasks, and numbered: a task's rows by their place in it, after all rows of
    the tasks before. ``segment`` is an item's place in its group over ``limit``, so
    it depends on the data alone. Nothing is dropped; ``order`` must identify an
    item within its group. Only one row a task goes through one window.
    """
    rows = df.select(*keys, *order, item.alias("_item")).orderBy(*keys, *order)
    placed = written(rows.withColumn("_at", F.monotonically_increasing_id()), "ordered-rows")
    task = F.shiftright("_at", 33)
    counts = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_task")) - F.col("_n")
    numbered = (
        placed.withColumn("_task", task)
        .join(counts.select("_task", before.alias("_before")), "_task")
        .withColumn("_place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    starts = numbered.groupBy([F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_place").alias("_start"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    segment = F.floor((F.col("_place") - F.col("_start")) / limit).cast("bigint").alias("segment")
    return (
        numbered.join(starts, same)
        .groupBy(*keys, segment)
        .agg(F.sort_array(F.collect_list(F.struct("_place", "_item"))).alias("_items"))
        .select(*keys, "segment", F.col("_items._item").alias("items"))
    )


def pages(sizes: DataFrame, page_size: int) -> DataFrame:
    """(keys, group_size) with ``pages``, over which the rows of a key are hashed by ``page_of``.

    Pages hold ``page_size`` rows on average, so collecting (key, page) groups is
    bounded for every key. Sizes are counted by the caller, before rows are joined.
    """
    return sizes.withColumn("pages", F.ceil(F.col("group_size") / page_size))


def page_of(row_id: str) -> Column:
    return F.pmod(F.xxhash64(row_id), F.col("pages"))
