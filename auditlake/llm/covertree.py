"""Embedding near-duplicates: exact cosine pairs by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). Cells
around pivots are the top level; each block of a cell has nodes of radius 1/2, and
nodes that need it are split into children of half their radius. A pair of nodes is
dropped if its centres are further apart than both radii and the threshold, and
taken whole if no two of its points can be; only what is left is split further.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.components import components
from auditlake.llm.workers import map_arrow, ship_package
from auditlake.session import written

BLOCK = 4096  # vectors of a block, about
PIVOTS = 256  # cells, at most
PIVOT_SAMPLE = 4096  # vectors the pivots are chosen from
FIRST_RADIUS = 0.5
SLACK = 1e-7  # rounding of distances, far above that of double precision
DIRECT = 1 << 14  # pairs of points that are compared at once instead of splitting nodes


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows are finite and not all zero."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def net(points: np.ndarray, radius: float) -> Iterator[np.ndarray]:
    """Groups of rows that cover all: each within ``radius`` of its first row, first rows further apart."""
    rest = np.arange(len(points))
    while len(rest):
        lead = rest[:256]
        near = _distances(points[lead], points[lead]) <= radius
        centres, free = [], np.ones(len(lead), bool)
        for k in range(len(lead)):
            if free[k]:
                centres.append(k)
                free &= ~near[k]
        distance = _distances(points[lead[centres]], points[rest])
        owner = distance.argmin(axis=0)
        inside = distance[owner, np.arange(len(rest))] <= radius
        owner[centres] = np.arange(len(centres))
        inside[centres] = True
        order = np.argsort(owner[inside], kind="stable")
        members, owners = rest[inside][order], owner[inside][order]
        for k, group in enumerate(np.split(members, np.searchsorted(owners, np.arange(1, len(centres))))):
            centre = lead[centres[k]]
            yield np.r_[centre, group[group != centre]]
        rest = rest[~inside]


@dataclass
class Node:
    rows: np.ndarray  # of the points, centre first
    radius: float  # largest distance of a row from the centre
    level: float  # covering radius of its level
    parts: list["Node"] | None = None

    def children(self, points: np.ndarray) -> list["Node"]:
        if self.parts is None:
            half = self.level / 2
            self.parts = [_node(points, self.rows[g], half) for g in net(points[self.rows], half)]
        return self.parts


def _node(points: np.ndarray, rows: np.ndarray, level: float) -> Node:
    radius = float(_distances(points[rows[:1]], points[rows]).max()) if len(rows) > 1 else 0.0
    return Node(rows, radius, level)


class Forest:
    """Union-find over rows; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.links.append((x, y))


def dual(points: np.ndarray, copies: np.ndarray, left: list[Node], right: list[Node] | None, cosine: float) -> tuple[np.ndarray, Forest]:
    """Per row the linked rows of the other side (with copies), and links that connect them.

    ``right`` None: all pairs within ``left``.
    """
    limit = math.sqrt(2 - 2 * cosine)
    links, forest = np.zeros(len(points), np.int64), Forest(len(points))

    def compare(a: np.ndarray, b: np.ndarray, same: bool) -> None:
        hit = points[a] @ points[b].T >= cosine
        if same:
            np.fill_diagonal(hit, False)
        if hit.any():
            links[a] += hit @ copies[b]
            if not same:
                links[b] += copies[a] @ hit
            # One link a row and one a column, and the rest only where they join new trees.
            x, y = np.nonzero(hit)
            if len(x) > len(a) + len(b):
                first = hit.argmax(axis=1)[hit.any(axis=1)]
                forest.join(a[hit.any(axis=1)], b[first])
                roots_a = np.array([forest.root(r) for r in a.tolist()])
                roots_b = np.array([forest.root(r) for r in b.tolist()])
                apart = roots_a[x] != roots_b[y]
                x, y = x[apart], y[apart]
            forest.join(a[x], b[y])

    def pairs(a: list[Node], b: list[Node] | None) -> Iterator[tuple[Node, Node, float]]:
        """Node pairs that may hold a link, with the distance of their centres."""
        other = b if b is not None else a
        if not a or not other:
            return
        centres_b = points[[n.rows[0] for n in other]]
        radii_b = np.array([n.radius for n in other])
        for start in range(0, len(a), 1024):
            part = a[start : start + 1024]
            distance = _distances(points[[n.rows[0] for n in part]], centres_b)
            reach = np.array([n.radius for n in part])[:, None] + radii_b[None, :] + limit + SLACK
            x, y = np.nonzero(distance <= reach)
            if b is None:
                half = x + start <= y
                x, y = x[half], y[half]
            for i, j in zip(x.tolist(), y.tolist()):
                yield part[i], other[j], float(distance[i, j])

    stack = [(left, right)]
    while stack:
        singles_a, singles_b = [], []
        for a, b, distance in pairs(*stack.pop()):
            if a is b:
                if len(a.rows) == 1:
                    continue
                if 2 * a.radius < limit - SLACK:  # every pair is linked
                    links[a.rows] += copies[a.rows].sum() - copies[a.rows]
                    forest.join(np.broadcast_to(a.rows[0], len(a.rows) - 1), a.rows[1:])
                elif len(a.rows) ** 2 <= DIRECT:
                    compare(a.rows, a.rows, True)
                else:
                    stack.append((a.children(points), None))
            elif len(a.rows) == 1 and len(b.rows) == 1:
                singles_a.append(a.rows[0])
                singles_b.append(b.rows[0])
            elif distance + a.radius + b.radius < limit - SLACK:
                links[a.rows] += copies[b.rows].sum()
                links[b.rows] += copies[a.rows].sum()
                forest.join(np.broadcast_to(a.rows[0], len(b.rows)), b.rows)
                forest.join(a.rows[1:], np.broadcast_to(b.rows[0], len(a.rows) - 1))
            elif len(a.rows) * len(b.rows) <= DIRECT or max(a.radius, b.radius) < SLACK:
                compare(a.rows, b.rows, False)
            else:
                parts = [n.children(points) if len(n.rows) > 1 and n.radius >= 0.5 * m.radius else [n] for n, m in ((a, b), (b, a))]
                stack.append((parts[0], parts[1]))
        if singles_a:
            a, b = np.array(singles_a), np.array(singles_b)
            hit = np.einsum("ij,ij->i", points[a], points[b]) >= cosine
            np.add.at(links, a[hit], copies[b[hit]])
            np.add.at(links, b[hit], copies[a[hit]])
            forest.join(a[hit], b[hit])
    return links, forest


def _pivots(sample: list[np.ndarray], count: int) -> np.ndarray:
    """Rows chosen one by one, each the furthest from those before."""
    points = units(np.stack(sample))
    chosen = [0]
    far = _distances(points[:1], points)[0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(points[chosen[-1:]], points)[0])
    return points[chosen]


def _links(distinct: DataFrame, size: int, cosine: float) -> DataFrame:
    """(a, b, n): ``b`` null: ``n`` links of vector ``a``; else a link. ``distinct``: (vector, first, copies) of one length."""
    total = distinct.count()
    sample = distinct.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(PIVOT_SAMPLE).collect()
    if not sample:
        return distinct.select(F.col("first").alias("a"), F.col("first").alias("b"), F.lit(0).cast("bigint").alias("n")).limit(0)
    read = lambda raw: np.frombuffer(raw, np.float64)
    spark = distinct.sparkSession
    pivots = spark.sparkContext.broadcast(_pivots([read(r["vector"]) for r in sample], min(PIVOTS, -(-total // BLOCK))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = units(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, size))
                far = _distances(points, pivots.value)
                cell = far.argmin(axis=1)
                values = [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *values], names=["vector", "first", "copies", "cell", "far"])

    cells = written(map_arrow(distinct, dealt, "vector binary, first bigint, copies bigint, cell int, far double"), "vector-cells")
    stats = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # PIVOTS rows
    splits = {r["cell"]: -(-r["n"] // BLOCK) for r in stats}
    reach = {r["cell"]: r["far"] for r in stats}
    number = F.create_map(*[F.lit(x) for pair in splits.items() for x in pair])
    blocks = cells.withColumn("split", F.pmod(F.xxhash64("first"), number[F.col("cell")]).cast("int"))

    def built(block: pa.Table) -> pa.Table:
        points = units(np.frombuffer(b"".join(block["vector"].to_pylist()), np.float64).reshape(-1, size))
        first, copies = block["first"].to_numpy(), block["copies"].to_numpy()
        rows = []
        for group in net(points, FIRST_RADIUS):
            node = _node(points, group, FIRST_RADIUS)
            rows.append((node.radius, points[group].tobytes(), first[group].tobytes(), copies[group].tobytes()))
        radius, packed, ids, counts = zip(*rows)
        n = len(rows)
        return pa.table(
            {
                "cell": pa.array([block["cell"][0].as_py()] * n, pa.int32()),
                "split": pa.array([block["split"][0].as_py()] * n, pa.int32()),
                "radius": pa.array(radius, pa.float64()),
                "points": pa.array(packed, pa.binary()),
                "first": pa.array(ids, pa.binary()),
                "copies": pa.array(counts, pa.binary()),
            }
        )

    ship_package(spark)
    kinds = "cell int, split int, radius double, points binary, first binary, copies binary"
    nodes = blocks.groupBy("cell", "split").applyInArrow(built, kinds)
    limit = math.sqrt(2 - 2 * cosine)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node goes to the pairs of its block with the blocks its points may reach."""
        for batch in batches:
            if not batch.num_rows:
                continue
            centres = np.stack([np.frombuffer(p.as_py(), np.float64, size) for p in batch.column(3)])
            far = _distances(centres, pivots.value)
            which, keys = [], []
            for k, (cell, split, radius) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                for other, parts in splits.items():
                    if other == cell or far[k, other] <= radius + reach[other] + limit + SLACK:
                        for part in range(parts):
                            low, high = sorted([(cell, split), (other, part)])
                            which.append(k)
                            keys.append((*low, *high))
            out = batch.take(pa.array(which, pa.int64()))
            names = ["c1", "s1", "c2", "s2"]
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array([x[k] for x in keys], pa.int32()) for k in range(4))], names=[*batch.schema.names, *names])

    def compared(pair: pa.Table) -> pa.Table:
        points = np.frombuffer(b"".join(pair["points"].to_pylist()), np.float64).reshape(-1, size)
        first = np.frombuffer(b"".join(pair["first"].to_pylist()), np.int64)
        copies = np.frombuffer(b"".join(pair["copies"].to_pylist()), np.int64)
        low = (pair["c1"][0].as_py(), pair["s1"][0].as_py())
        high = (pair["c2"][0].as_py(), pair["s2"][0].as_py())
        sides: tuple[list[Node], list[Node]] = ([], [])
        at = 0
        for cell, split, radius, ids in zip(*(pair[c].to_pylist() for c in ("cell", "split", "radius", "first"))):
            n = len(ids) // 8
            sides[(cell, split) != low].append(Node(np.arange(at, at + n), radius, FIRST_RADIUS))
            at += n
        links, forest = dual(points, copies, sides[0], None if low == high else sides[1], cosine)
        some = np.flatnonzero(links)
        joined = np.array(forest.links, np.int64).reshape(-1, 2)
        a = np.r_[first[some], first[joined[:, 0]]]
        b = pa.array([None] * len(some), pa.int64())
        b = pa.concat_arrays([b, pa.array(first[joined[:, 1]], pa.int64())])
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array(np.r_[links[some], np.zeros(len(joined), np.int64)], pa.int64())})

    pairs = map_arrow(nodes, sent, f"{kinds}, c1 int, s1 int, c2 int, s2 int").groupBy("c1", "s1", "c2", "s2")
    return pairs.applyInArrow(compared, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """(id bigint, n_links, component_id, kept) per row: vectors of at least this cosine, in double precision.

    ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest id reachable, the row's own included; ``kept``
    says whether it is the row's own. A null or empty vector, one of zeros, or one
    with a null or non-finite component links with nothing, nor do vectors of
    different lengths with each other. Repeated rows are copies of each other; rows
    without id are linked but are named by no component. An empty table gives no
    row; other columns are not read.

    Exact for any data; how much is pruned depends on it. Vectors without any
    structure are compared block by block, each block of 4096 with all others, so
    the work then grows with the square of the rows.
    """
    if not -1 < cosine <= 1:
        raise ValueError("cosine must be above -1 and at most 1")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column(1):
                items = value.as_py()
                row = np.array([np.nan if x is None else x for x in items], np.float64) if items else np.zeros(0)
                good = len(row) and np.isfinite(row).all() and row.any()
                packed.append((row + 0.0).tobytes() if good else None)
            sizes = pa.array([None if p is None else len(p) // 8 for p in packed], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), sizes], names=["id", "vector", "size"])

    source = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    rows = written(map_arrow(source, read, "id bigint, vector binary, size int"), "vectors")
    marked = rows.filter(F.col("vector").isNotNull()).groupBy("size", "vector")
    # The name of a vector without any id is a negative hash no id has; it is never shown.
    name = F.coalesce(F.min("id"), -F.abs(F.xxhash64("vector")) - 1)
    distinct = written(marked.agg(name.alias("first"), F.count("*").alias("copies")), "distinct-vectors")
    sizes = [r["size"] for r in distinct.select("size").distinct().collect()]
    found = None
    for size in sizes:
        part = _links(distinct.filter(F.col("size") == size).select("vector", "first", "copies"), size, cosine)
        found = part if found is None else found.union(part)
    alone = rows.filter(F.col("vector").isNull()).select(
        F.col("id").alias(id), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    if found is not None:
        found = written(found, "vector-links")
        counts = found.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n"))
        classes = components(found.filter(F.col("b").isNotNull()))
        known = (
            distinct.join(counts, distinct["first"] == counts["a"], "left")
            .join(classes, distinct["first"] == classes["node"], "left")
            .select("size", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
        )
        linked = rows.join(known, ["size", "vector"]).select(F.col("id").alias(id), "n_links", "component_id")
        alone = alone.unionByName(linked)
    return alone.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
