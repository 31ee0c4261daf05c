"""Sharding by minimax contiguous partition, in DataFrame operations only.

Documents with equal text form one atomic group. Groups stand in the order of
their text hash; ``n_shards`` contiguous runs of groups become the shards. The
capacity is the smallest one for which a greedy fill needs no more than
``n_shards`` runs, found by binary search, and the cuts never exceed it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import written

BIN_BITS = 12  # running sums are windows over 2^12 ranges of the hash
SUMMARY_ROWS = 1 << 14  # rows the driver reads per refinement (16 a shard for over 1024 shards), whatever the input
SLOT_PARTS = 8192  # windows that number the rows of all shards


@dataclass
class Run:
    """Consecutive group ends from ``first`` to ``last``; ``hidden`` if others lie between."""

    first: int
    last: int
    hidden: bool


class Ends:
    """What is known so far of the cumulated sizes at which groups end."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.firsts = [run.first for run in runs]
        self.lasts = [run.last for run in runs]
        self.total = runs[-1].last

    def known(self, x: int) -> int:
        """The largest end at or before ``x`` that is known (0: none)."""
        at = bisect_right(self.firsts, x) - 1
        if at < 0:
            return 0
        return self.lasts[at] if self.lasts[at] <= x else self.firsts[at]

    def possible(self, x: int) -> int:
        """An upper bound of the largest end at or before ``x``."""
        at = bisect_right(self.firsts, x) - 1
        if at < 0:
            return 0
        run = self.runs[at]
        return run.last if run.last <= x else x if run.hidden else run.first

    def known_from(self, x: int) -> int:
        """The smallest known end at or after ``x``."""
        at = bisect_left(self.lasts, x)
        return self.firsts[at] if self.firsts[at] >= x else self.lasts[at]

    def greedy(self, capacity: int, shards: int, fill) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = fill(at + capacity)
            cuts.append(at)
        return cuts

    def smallest(self, shards: int, fill) -> int:
        """The smallest capacity whose greedy fill takes everything."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.greedy(middle, shards, fill)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


def _summary(groups: DataFrame, ranges: list[tuple[int, int]], steps: int) -> list[Run]:
    """First and last end in each of at most ``steps`` (+ 2 a range) equal steps of the ranges."""
    width = max(1, -(-sum(high - low + 1 for low, high in ranges) // steps))
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | F.col("end").between(low, high)
    rows = (
        groups.filter(inside)
        .groupBy(F.floor(F.col("end") / width).alias("step"))
        .agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count("*").alias("n"))
        .collect()
    )
    return sorted((Run(r["first"], r["last"], r["n"] > 2) for r in rows), key=lambda run: run.first)


def _cuts(groups: DataFrame, total: int, shards: int) -> list[int]:
    """Cumulated sizes at which shards end, for the smallest capacity.

    The driver holds a bounded summary of the group ends. It brackets the
    capacity between one that only uses known ends and one that assumes an end
    wherever one may be, and reads the ranges finer in which the cuts of the two
    can still differ, until both agree: the result is exact at any size.
    """
    steps, length = max(SUMMARY_ROWS, 16 * shards), total
    ends = Ends(_summary(groups, [(0, total)], steps))
    while True:
        upper = ends.smallest(shards, ends.known)
        lower = ends.smallest(shards, ends.possible)
        if lower == upper:
            break
        least = ends.greedy(lower, shards, ends.known)
        most = ends.greedy(upper, shards, ends.possible)
        ranges: list[list[int]] = []
        for a, b in sorted(zip(least, most)):
            touched = [r for r in ends.runs[max(0, bisect_left(ends.lasts, a)) : bisect_right(ends.firsts, b)] if r.hidden]
            if not touched:
                continue
            low, high = touched[0].first, touched[-1].last
            if ranges and low <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], high)
            else:
                ranges.append([low, high])
        before, length = length, sum(high - low + 1 for low, high in ranges)
        if 2 * length > before:  # so that ranges always get finer
            steps *= 2
        finer = _summary(groups, [(low, high) for low, high in ranges], steps)
        outside = [r for r in ends.runs if not any(low <= r.first and r.last <= high for low, high in ranges)]
        ends = Ends(sorted(outside + finer, key=lambda run: run.first))

    # Any cuts between the fill from the end and the fill from the start keep the
    # capacity; of these the ones nearest to equal sizes of what is left are taken.
    capacity, earliest = upper, [ends.total]
    for _ in range(shards - 1):
        target = earliest[-1] - capacity
        earliest.append(0 if target <= 0 else ends.known_from(target))
    earliest.reverse()
    cuts, at = [], 0
    for k in range(shards - 1):
        goal = at + (ends.total - at) // (shards - k)
        below = ends.known(goal)
        above = ends.known_from(goal)
        best = below if goal - below <= above - goal else above
        at = min(max(best, earliest[k], at), ends.known(at + capacity))
        cuts.append(at)
    return cuts


def _offsets(counts: DataFrame, value: str, order: str, by: list[str]) -> Column:
    """The sum of ``value`` over the rows before, in a table of bounded size."""
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.sum(value).over(window.orderBy(order)) - F.col(value)


def shard(docs: DataFrame, n_shards: int = 8, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, group_key, shard, slot): each row's shard and its place there.

    ``size`` is the UTF-8 length of the text plus 1 (null: 1); ``text_crc32`` is
    null for a null text. Equal texts share a ``group_key`` and a shard; null
    texts are one group, empty texts another. Two texts of equal hash would only
    form one larger group. The largest shard is as small as contiguous runs of
    groups allow, so a group above the mean size takes a shard of its own size.
    ``slot`` counts the rows of a shard from 0 without gaps, in the order of a
    hash of the id, then id. Repeated rows count each; an empty table gives no
    row; other columns are not read, so their names can't clash.

    Texts are read once and never shuffled. Running sums over groups are windows
    within 2^12 ranges of the hash; slots are windows over 8192 parts of the ids,
    so a group with a third of all rows spreads over the parts of its shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = written(
        docs.select(
            F.col(id).alias("_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
            F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group_key"),
        ),
        "shard-rows",
    )
    sizes = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    binned = sizes.withColumn("bin", F.shiftright("group_key", 64 - BIN_BITS))
    bins = binned.groupBy("bin").agg(F.sum("bytes").alias("bytes"))
    starts = bins.select("bin", _offsets(bins, "bytes", "bin", []).alias("start"))
    running = F.sum("bytes").over(Window.partitionBy("bin").orderBy("group_key"))
    groups = written(
        binned.join(F.broadcast(starts), "bin").select("group_key", (F.col("start") + running).alias("end")),  # 2^12 rows
        "shard-groups",
    )
    total = groups.agg(F.max("end")).head()[0] or 0
    cuts = _cuts(groups, total, n_shards) if total else []
    keys = {r["end"]: r["group_key"] for r in groups.filter(F.col("end").isin(sorted(set(cuts) - {0}))).collect()}
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.lit(True) if cut == 0 else F.col("group_key") > keys[cut]).cast("int")

    placed = rows.withColumn("shard", number).withColumn(
        "_part", F.pmod(F.xxhash64("_id"), F.lit(-(-SLOT_PARTS // n_shards)))
    )
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "_part", _offsets(counts, "n", "_part", ["shard"]).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_id", "group_key"))
    return placed.join(F.broadcast(before), ["shard", "_part"]).select(  # at most SLOT_PARTS + n_shards rows
        F.col("_id").alias(id), "size", "text_crc32", "group_key", "shard", (F.col("before") + within - 1).alias("slot")
    )
