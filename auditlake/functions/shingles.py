"""Token windows of file texts, in numpy over the files of an Arrow batch.

Only the arithmetic of windows within a file is done here; Spark reads the files,
and groups and joins what is found. Texts are taken as their UTF-8 bytes: words
are runs of ``[A-Za-z0-9_]``, every other code point that is no blank is a token.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

CHUNK = 1 << 20  # bytes of text at once, unless one file has more
BLANK, WORD, OTHER, INSIDE = range(4)  # kinds of bytes; INSIDE: not the first of a code point
KIND = np.full(256, OTHER, np.uint8)
KIND[list(b" \t\r\n\f")] = BLANK
KIND[list(b"_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = WORD
KIND[0x80:0xC0] = INSIDE
GOES_ON = {(WORD, WORD), (OTHER, INSIDE), (INSIDE, INSIDE)}
OPENS = np.array([kind != BLANK and (before, kind) not in GOES_ON for before in range(4) for kind in range(4)])  # a token

# Columns of what is found; ``minimum`` and ``h2`` cover the repository too.
RUN = "weight int, minimum bigint, first int, last int, h1 bigint, first_line int, last_line int, first_at int, last_at int"
WINDOW = "h1 bigint, first_line int, last_line int, first_at int, last_at int, h2 bigint"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _over_spans(values: np.ndarray, span: int, combine: Callable) -> np.ndarray:
    """Element i is the combination of ``values[i .. i+span-1]``, doubling the span step by step.

    The last step may overlap, which neither a minimum nor a hash of content minds.
    """
    width = 1
    while width < span:
        step = min(width, span - width)
        values = combine(values[: max(len(values) - step, 0)], values[step:])
        width += step
    return values


def _hashes(words: pa.BinaryArray) -> np.ndarray:
    coded = words.dictionary_encode()
    return pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy()]


class Windows:
    """The tokens, k-grams and windows of some files whose bytes follow one another."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, repo: np.ndarray, min_tokens: int):
        """``ends``: where files begin and end in ``data``, one more than there are files; ``repo``: a hash of each file's repository."""
        self.width, self.gram, self.repo = min_tokens, (min_tokens + 1) // 2, repo
        opening = ends[:-1][ends[:-1] < ends[1:]]
        kind = KIND[data]
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[opening] = BLANK
        place = np.flatnonzero(OPENS[before * 4 + kind])
        self.start = np.searchsorted(place, ends)  # first token of each file
        self.file = np.repeat(np.arange(len(ends) - 1), np.diff(self.start))

        filled = kind != BLANK
        offsets = np.append(np.cumsum(filled, dtype=np.int32)[place] - 1, np.count_nonzero(filled)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(data[filled])])
        hashes = _hashes(words)

        returned = np.zeros(len(data), bool)  # is the byte before a carriage return of the same file?
        returned[1:] = data[:-1] == 13
        returned[opening] = False
        breaks = np.cumsum((data == 13) | ((data == 10) & ~returned), dtype=np.int32)
        self.line = breaks[place] - np.append(np.int32(0), breaks)[ends[:-1]][self.file] + 1
        fresh = np.ones(len(place), bool)
        fresh[1:] = (self.line[1:] != self.line[:-1]) | (self.file[1:] != self.file[:-1])
        among = np.cumsum(fresh, dtype=np.int32)  # lines with tokens
        self.at = among - among[self.start[self.file]]
        self.grams = _over_spans(hashes, self.gram, _mixed)

    def whole(self, start: np.ndarray) -> np.ndarray:
        """Is the window from this token within one file?"""
        end = start + self.width - 1
        inside = end < len(self.file)
        inside[inside] = self.file[start[inside]] == self.file[end[inside]]
        return inside

    def content(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows from these tokens, each over both of its halves."""
        head, tail = self.grams[start], self.grams[start + self.width - self.gram]
        return _mixed(head, tail), _mixed(tail, head)

    def lines(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """First and last line of the windows that start from ``first`` to ``last``, by number and by place."""
        end = last + self.width - 1
        return [self.line[first], self.line[end], self.at[first], self.at[end]]

    def runs(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The file and the columns ``RUN`` of each stretch of windows with one minimum."""
        start = np.flatnonzero(self.whole(np.arange(len(self.file))))
        minima, file = _over_spans(self.grams, self.width - self.gram + 1, np.minimum)[start], self.file[start]
        opens = np.ones(len(start), bool)
        opens[1:] = (minima[1:] != minima[:-1]) | (file[1:] != file[:-1])
        at = np.flatnonzero(opens)
        if not len(at):
            return at, [at] * len(RUN.split(","))
        place = np.arange(len(start)) - np.repeat(at, np.diff(np.append(at, len(start))))
        whole = np.add.reduceat(_mixed(self.content(start)[0], place.astype(np.uint64)), at)
        first, last = start[at], start[np.append(at[1:], len(start)) - 1]

        # A window that comes again within its run has a minimum that comes again in the file.
        told = np.sort(_mixed(self.grams, self.file[: len(self.grams)].astype(np.uint64)))
        again = np.unique(told[1:][told[1:] == told[:-1]])
        weight = 1 + np.isin(_mixed(minima[at], file[at].astype(np.uint64)), again)
        shift = self.start[file[at]]
        minimum = _mixed(minima[at], self.repo[file[at]])
        return file[at], [weight, minimum.view(np.int64), first - shift, last - shift, whole.view(np.int64), *self.lines(first, last)]

    def chosen(self, file: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The file and the columns ``WINDOW`` of the windows from tokens ``first`` to ``last`` of files, each once."""
        sizes = last - first + 1
        at = np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = np.unique(np.repeat(self.start[file] + first, sizes) + np.arange(len(at)) - at)
        start = start[self.whole(start)]
        h1, h2 = self.content(start)
        h2 = _mixed(h2, self.repo[self.file[start]])
        return self.file[start], [h1.view(np.int64), *self.lines(start, start), h2.view(np.int64)]


def _chunks(content: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``begin`` to ``end`` of texts, their bytes, and where they begin and end in these."""
    binary = content.cast(pa.large_binary())
    if not len(binary):
        return
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(binary):
        end = max(int(np.searchsorted(offsets, offsets[begin] + CHUNK, "right")) - 1, begin + 1)
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def _rows(batch: pa.RecordBatch, begin: int, file: np.ndarray, columns: list[np.ndarray], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    key = pa.array(file + begin)
    found = [pa.array(column).cast(kind) for column, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(key), batch.column(1).take(key), *found], names)


def _types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [column.split() for column in schema.split(", ")]
    return ["repo", "path", *(name for name, _ in pairs)], [pa.int64() if kind == "bigint" else pa.int32() for _, kind in pairs]


def runs(min_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(repo, path, content, hash of repo) -> repo, path and ``RUN``."""
    names, kinds = _types(RUN)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repo = batch.column(3).to_numpy().view(np.uint64)
            for begin, end, data, ends in _chunks(batch.column(2)):
                yield _rows(batch, begin, *Windows(data, ends, repo[begin:end], min_tokens).runs(), names, kinds)

    return find


def windows(min_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(repo, path, content, hash of repo, list of first and last) -> repo, path and ``WINDOW`` of windows that start there."""
    names, kinds = _types(WINDOW)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repo = batch.column(3).to_numpy().view(np.uint64)
            for begin, end, data, ends in _chunks(batch.column(2)):
                wanted = batch.column(4).slice(begin, end - begin)
                file = np.repeat(np.arange(end - begin), wanted.value_lengths().to_numpy())
                first, last = (wanted.flatten().field(k).to_numpy() for k in (0, 1))
                yield _rows(batch, begin, *Windows(data, ends, repo[begin:end], min_tokens).chosen(file, first, last), names, kinds)

    return find
