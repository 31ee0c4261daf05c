"""Packing token ids into rows of fixed length by best-fit decreasing.

Documents longer than a row are split without loss into full rows and a rest. The
rests of a window of documents are packed longest first, each into the row with
the least room that still takes it; a segment tree over the amounts of room finds
that row in logarithmic time. Rows hold an id matrix, the cumulated lengths of
their segments and positions that start again with each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.bpe import pieces_of_batch, tokenizer
from auditlake.llm.workers import map_arrow

WINDOW_TOKENS = 8 << 20  # tokens of a packing window: a task holds one at a time


class Room:
    """How many open rows have each amount of room; a segment tree of counts."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.counts = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = room + self.width
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(row, room) of a row with the smallest room of at least ``least``; the row is no longer open."""
        counts, node = self.counts, least + self.width
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node ^ 1]):
                node >>= 1
            if node <= 1:
                return None
            node ^= 1
            while node < self.width:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.width
        while node:
            counts[node] -= 1
            node >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers; each item goes to the fullest row with room for it, longest items first."""
    rows: list[list[int]] = []
    room = Room(length)
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = room.take(sizes[item])
        if found is None:
            rows.append([])
            found = (len(rows) - 1, length)
        row, free = found
        rows[row].append(item)
        if free > sizes[item]:
            room.add(row, free - sizes[item])
    return rows


PACKED = """pack_id bigint, n_tokens int, n_segments int, input_ids binary, position_ids binary,
    cu_seqlens array<int>, doc_ids array<{id}>, doc_starts array<bigint>"""


def _packed(window: list[tuple[object, np.ndarray]], length: int, pad: int, first: int, id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    segments = [(k, start) for k, (_, ids) in enumerate(window) for start in range(0, len(ids), length)]
    sizes = [min(length, len(window[k][1]) - start) for k, start in segments]
    full = [[s] for s, size in enumerate(sizes) if size == length]
    rests = [s for s, size in enumerate(sizes) if size < length]
    rows = full + [[rests[s] for s in row] for row in best_fit_decreasing([sizes[s] for s in rests], length)]
    kind = window[0][1].dtype
    matrix = np.full((len(rows), length), pad, kind)
    positions = np.zeros((len(rows), length), np.int32)
    ends, docs, starts = [], [], []
    for r, row in enumerate(rows):
        at, row_ends = 0, [0]
        for s in row:
            k, start = segments[s]
            matrix[r, at : at + sizes[s]] = window[k][1][start : start + sizes[s]]
            positions[r, at : at + sizes[s]] = np.arange(sizes[s])
            at += sizes[s]
            row_ends.append(at)
        ends.append(row_ends)
        docs.append([window[segments[s][0]][0] for s in row])
        starts.append([segments[s][1] for s in row])
    values = [
        pa.array(range(first, first + len(rows)), pa.int64()),
        pa.array([e[-1] for e in ends], pa.int32()),
        pa.array([len(d) for d in docs], pa.int32()),
        pa.array([m.tobytes() for m in matrix], pa.binary()),
        pa.array([p.tobytes() for p in positions.astype(np.uint16 if length <= 1 << 16 else np.uint32)], pa.binary()),
        pa.array(ends, pa.list_(pa.int32())),
        pa.array(docs, pa.list_(id_type)),
        pa.array(starts, pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(values, names=names)


def _pack_stream(docs: Iterator[tuple[object, np.ndarray]], length: int, pad: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in PACKED.split(",")]
    first = TaskContext.get().partitionId() << 33
    window, held = [], 0
    for doc in docs:
        window.append(doc)
        held += len(doc[1])
        if held >= WINDOW_TOKENS:
            out = _packed(window, length, pad, first, id_type, names)
            first += out.num_rows
            window, held = [], 0
            yield out
    if window:
        yield _packed(window, length, pad, first, id_type, names)


def pack_texts(docs: DataFrame, path: str, eos: int, length: int = 2048, pad: int = 0, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows of ``length`` token ids packed from whole texts, each followed by ``eos``.

    (pack_id, n_tokens, n_segments, input_ids, position_ids, cu_seqlens, doc_ids,
    doc_starts): ``input_ids`` is a row of the id matrix, little-endian unsigned 16
    bit, ``pad`` after ``n_tokens``; ``position_ids`` (16 bit, 32 for rows over
    65,536) start from 0 with each segment; ``cu_seqlens`` are the cumulated segment
    lengths from 0; segment i holds the tokens of document ``doc_ids[i]`` from its
    token ``doc_starts[i]``. Every token of every document is in exactly one
    segment, so null and empty texts, which are one ``eos``, and repeated rows are
    kept too. An empty table gives no row; other columns are not read.

    Documents are packed where they are read, in windows of about 8 M tokens (one
    document may exceed that), so no token is shuffled and a lost executor costs
    its own tasks; a window wastes on average less than a row. ``pack_id`` is
    unique and grows within a task.
    """
    with open(path, "rb") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    id_type = dict(docs.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        stop = np.array([eos], "<u2")
        kind = None

        def encoded():
            nonlocal kind
            for batch in batches:
                kind, done = batch.schema.field(0).type, 0
                for texts in pieces_of_batch(batch.column(1)):
                    keys = batch.column(0).slice(done, len(texts)).to_pylist()
                    done += len(texts)
                    for key, ids in zip(keys, bpe.encode(texts)):
                        yield key, np.append(np.frombuffer(ids, "<u4").astype("<u2"), stop)

        stream = encoded()
        head = next(stream, None)
        if head is not None:
            yield from _pack_stream(_chain(head, stream), length, pad, kind)

    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    return map_arrow(rows, run, PACKED.format(id=id_type))


def pack_ids(tokens: DataFrame, length: int = 2048, pad: int = 0, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """``pack_texts`` for rows that hold their ids already, as little-endian unsigned 32-bit binary; rows without ids hold no segment."""
    id_type = dict(tokens.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def held():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if x.as_py():
                        yield key, np.frombuffer(x.as_py(), "<u4")

        stream = held()
        head = next(stream, None)
        if head is not None:
            yield from _pack_stream(_chain(head, stream), length, pad, kind)

    rows = tokens.select(F.col(id).alias("_id"), F.col(ids).alias("_ids"))
    return map_arrow(rows, run, PACKED.format(id=id_type))


def _chain(head, rest):
    yield head
    yield from rest


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet below a path all executors share; Spark's commit keeps reruns whole."""
    packed.write.parquet(path)
