"""The prefix trie of conversations, built by peeling off last turns.

Conversations are paths of turns. Peeling starts at the deepest turn: the paths
that end there join the nodes that survive from below, each node is complete, its
last turn is stripped and the nodes are grouped by what is left. One descent
finds all nodes and sums up all subtrees.

Equal paths are merged first, then paths are sorted over all tasks, and each task
peels runs of neighbours. A node cut by a seam between two runs is found in both;
as all its figures are sums, the parts are added up, less what the two paths at
the seam have in common. Nothing is peeled twice, whatever a node's size.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.workers import map_arrow
from auditlake.session import written

DIGITS = 32  # hex digits of a turn in a path, and of a node's key: 128 bits of SHA-256
RUN_TURNS = 200_000  # turns peeled at once
SEGMENT_IDS = 4096  # conversation ids in a piece of text that is hashed

NODE = "key string, parent string, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
FIGURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turns_of(conversations: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digests and code points; null turns first."""
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    digest = F.substring(F.sha2(F.concat(F.octet_length(who), F.lit(":"), who, said), 256), 1, DIGITS)
    rows = conversations.filter(F.col(id).isNotNull()).select(
        F.col(id).cast("bigint").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(said).alias("size")).alias("said"),
    )
    ordered = F.sort_array(F.collect_list("said"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda s: F.struct(s["digest"].alias("digest"), s["size"].alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame, every: int = 100, modulus: int = 6) -> DataFrame:
    """(conv_id, path, sizes): the first h turns of the conversation at the last multiple of ``every``, then its own after its h.

    h is the crc32 of the id as text, modulo ``modulus``.
    """
    c = F.col("conv_id")
    heads = turns.filter(c % every == 0).select(c.alias("head_id"), F.slice("turns", 1, modulus - 1).alias("head"))
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus)).cast("int")
    joined = turns.select("conv_id", "turns", (c - c % every).alias("head_id"), h.alias("h")).join(heads, "head_id", "left")
    none = F.array().cast("array<struct<digest:string,size:int>>")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, own).alias("t")).select("conv_id", F.array_join("t.digest", "").alias("path"), F.col("t.size").alias("sizes"))


def _key(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, DIGITS)


def peel(paths: list[tuple[str, list[int], int, int]]) -> Iterator[tuple]:
    """Node rows of some distinct paths: (path, sizes, conv_id, n_convs) each.

    From the deepest turn up: what ends at a depth joins the nodes that survive
    from below; a node without children is a leaf; all are yielded, stripped and
    regrouped by the path before their last turn.
    """
    ending = defaultdict(list)
    for path, sizes, conv, count in paths:
        running = hashlib.sha256()
        keys = [running.hexdigest()[:DIGITS]]
        for at in range(0, len(path), DIGITS):
            running.update(path[at : at + DIGITS].encode())
            keys.append(running.hexdigest()[:DIGITS])
        ending[len(sizes)].append((keys, sizes, conv, count))
    survivors: dict[str, list] = {}  # key: keys, sizes, conv_id, n_convs, n_children, n_leaves, saved_tokens
    for depth in range(max(ending, default=-1), -1, -1):
        for keys, sizes, conv, count in ending.get(depth, ()):
            node = survivors.setdefault(keys[depth], [keys, sizes, conv, 0, 0, 0, 0])
            node[2] = min(node[2], conv)
            node[3] += count
        stripped: dict[str, list] = {}
        for key, (keys, sizes, conv, count, children, leaves, saved) in survivors.items():
            parent = keys[depth - 1] if depth else None
            leaves += not children
            saved += (count - 1) * sizes[depth - 1] if depth else 0
            yield key, parent, depth, conv, count, children, leaves, saved
            if depth:
                node = stripped.setdefault(parent, [keys, sizes, conv, 0, 0, 0, 0])
                node[2] = min(node[2], conv)
                node[3] += count
                node[4] += 1
                node[5] += leaves
                node[6] += saved
        survivors = stripped


def seam(last: str, first: str, sizes: list[int]) -> Iterator[tuple[str, int, int, int]]:
    """(key, n_children, n_leaves, saved_tokens) to add where one run ends with ``last`` and the next begins with ``first``.

    Both runs count the nodes that the two paths share. Each was one more child of
    its parent, and its own text was taken off once too often in every node above;
    a path that the next one continues was no leaf.
    """
    common = 0
    for at in range(0, min(len(last), len(first)), DIGITS):
        if last[at : at + DIGITS] != first[at : at + DIGITS]:
            break
        common += 1
    leaf = -1 if common * DIGITS == len(last) else 0
    saved, running = sum(sizes[:common]), hashlib.sha256()
    for depth in range(common + 1):
        if depth:
            running.update(first[(depth - 1) * DIGITS : depth * DIGITS].encode())
        yield running.hexdigest()[:DIGITS], -1 if depth < common else 0, leaf, saved
        if depth:
            saved -= sizes[depth - 1]


def peeled(paths: DataFrame) -> DataFrame:
    """(key, parent, depth, conv_id, figures): all nodes of distinct (path, sizes, conv_id, n_convs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0

        def out() -> pa.RecordBatch:
            rows = [(*node, None, None, None) for node in peel(held)]
            rows.append((*[None] * 8, held[0][0], held[-1][0], held[0][1]))
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.int32())]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                turns += len(row[1]) + 1
                if turns > RUN_TURNS:
                    yield out()
                    held, turns = [], 0
        if held:
            yield out()

    names = ["key", "parent", "depth", "conv_id", *FIGURES, "first_path", "last_path", "first_sizes"]
    ordered = paths.select("path", "sizes", "conv_id", "n_convs").repartitionByRange("path").sortWithinPartitions("path")
    parts = written(map_arrow(ordered, run, f"{NODE}, first_path string, last_path string, first_sizes array<int>"), "trie-parts")

    def sewn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for last, first, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(key, None, None, None, 0, *more) for key, *more in seam(last, first, sizes)]
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names[:8])

    # One row a run of RUN_TURNS turns, or a task.
    runs = parts.filter(F.col("key").isNull()).select(F.lag("last_path").over(Window.orderBy("first_path")).alias("last"), "first_path", "first_sizes")
    seams = map_arrow(runs.filter(F.col("last").isNotNull()), sewn, NODE)
    every = parts.filter(F.col("key").isNotNull()).select(names[:8]).unionByName(seams)
    sums = [F.sum(c).alias(c) for c in FIGURES]
    return every.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the digest of each key's ids in order, comma-joined.

    Ids are sorted over all tasks and joined to pieces there; the one task that
    hashes a key's ids gets its pieces in order and holds one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([key]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])]
            return pa.RecordBatch.from_arrays(columns, names=["key", "first", "ids"])

        for batch in batches:
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (k != key or len(held) >= SEGMENT_IDS):
                    yield out()
                    held = []
                key = k
                held.append(conv)
        if held:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for k, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k == key:
                    running.update(b"," + ids.encode())
                else:
                    if running:
                        done.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], names=["key", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])

    dealt = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = map_arrow(dealt, joined, "key string, first bigint, ids string")
    return map_arrow(pieces.repartition("key").sortWithinPartitions("key", "first"), hashed, "key string, ends_sha256 string")


def trie(
    conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 100, modulus: int = 6
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, figures, ends_sha256, key): one row per node of the rebuilt conversations.

    A null role or text is empty and a null turn comes first; turns that share a
    number are ordered by their digest. Repeated rows are turns of their own. Rows
    without id belong to no conversation. A rebuilt conversation may have no turn:
    it is a member of the root alone, which has no parent. An empty table gives no
    row; other columns are not read, so their names can't clash.

    Texts stay in the tasks that read them; a turn goes on as 128 bits and a size.
    A conversation's turns are one row of that, so texts of any length are fine,
    and equal conversations are merged before paths are sorted.
    """
    paths = written(rebuilt(turns_of(conversations, id, turn, role, text), every, modulus), "trie-conversations")
    distinct = paths.groupBy("path", "sizes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    found = peeled(distinct).join(ends(paths.select(_key(F.col("path")).alias("key"), "conv_id")), "key", "left")
    nodes = written(found, "trie-nodes")
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(parents, "parent", "left").select(
        F.col("conv_id").alias(id), "depth", "parent_conv_id", *FIGURES, F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "key"
    )
