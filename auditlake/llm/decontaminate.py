"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark windows.

Texts are normalised to lower-case words. An item's windows are its runs of
``width`` words, or all its words if it has fewer. The automaton works on words,
numbered by the benchmark's own vocabulary, and scans a document once; hits are
word positions, mapped back to UTF-8 offsets of the original text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.workers import keep_rows, map_arrow, with_text
from auditlake.session import written

BLOCK_CHARS = 8 << 20  # benchmark text in one automaton
PASS_BLOCKS = 4  # automata of one pass over the documents; what the driver and a worker hold at a time

# A-Z become a-z; every other ASCII byte that is no digit or letter ends a word.
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with words lower-cased and everything between them blank: same length, same offsets."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


class Windows:
    """The automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normalised(text).split()]
            for start in range(max(1, len(words) - width + 1) if words else 0):
                owners = found[tuple(words[start : start + width])]
                if item is not None:
                    owners.add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, owners in found.items():
            self.automaton.add_word(window, (len(window), sorted(owners)))
        self.automaton.make_automaton()
        self.empty = not found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs [first, end) of hit words, and the items whose windows occur."""
        runs: list[list[int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return [], items
        get = self.numbers.get
        for last, (length, owners) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            items.update(owners)
            first = last + 1 - length
            while runs and runs[-1][1] >= first:  # windows of any length end in order
                first = min(first, runs.pop()[0])
            runs.append([first, last + 1])
        return [(a, b) for a, b in runs], items


@lru_cache(maxsize=PASS_BLOCKS)
def _windows(items: tuple[tuple[str | None, str], ...], width: int) -> Windows:
    return Windows(list(items), width)


def _offsets(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """UTF-8 offsets [first, end) of runs of words in a normalised text."""
    found, at, number = [], 0, 0
    edges = iter(sorted(runs))
    run = next(edges, None)
    first = 0
    for word in text.split(b" "):
        if word:
            if run and number == run[0]:
                first = at
            number += 1
            if run and number == run[1]:
                found.append((first, at + len(word)))
                run = next(edges, None)
        at += len(word) + 1
    return found


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    text: str = "text",
    id: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, *keep, n_words, n_hit, items, runs, spans) per row of ``docs``.

    ``items``: ids (as strings, sorted as such) of the items with an occurring
    window; ``runs``: [first, end) of hit words; ``spans``: the same as UTF-8
    offsets of the original text. Null and empty texts have no words; items
    without words have no windows. Windows of items without id hit like any other,
    but nothing is named for them. Items that repeat count once. An empty benchmark hits nothing, an empty ``docs`` gives no
    row. ``keep`` names columns to pass through; no name of theirs clashes.

    The benchmark goes to the workers in blocks of bounded size, one automaton each,
    ``PASS_BLOCKS`` of them with one pass over the documents. A larger benchmark
    takes more passes: each but the last is written, with the texts and the hits so
    far, so the driver and a worker never hold more than the blocks of one pass.
    """
    names = [id, *(keep or [])]
    rows, _, at = with_text(docs, names, text)
    result = T.StructType([*rows.schema.fields[: len(names)], *RESULT.fields])
    carried = T.StructType([*result.fields[:-1], T.StructField("_whole", T.StringType())])  # spans come last
    arrow = [pa.int64(), pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.list_(pa.int64()))] * 2]
    width_of = len(names)

    def pass_over(blocks: list, before: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1 if before else at)
                folded = [normalised(t.as_py()) for t in texts]
                words = [t.split() for t in folded]
                runs = [[tuple(r) for r in x] for x in batch.column("runs").to_pylist()] if before else [[] for _ in folded]
                items = [set(x) for x in batch.column("items").to_pylist()] if before else [set() for _ in folded]
                for shared in blocks:
                    windows = _windows(shared.value, width)
                    for k, found_words in enumerate(words):
                        found, owners = windows.scan(found_words)
                        runs[k] += found
                        items[k] |= owners
                runs = [_joined(r) for r in runs]
                values = [[len(w) for w in words], [sum(b - a for a, b in r) for r in runs], [sorted(x) for x in items], runs]
                if last:
                    values.append([_offsets(t, r) if r else [] for t, r in zip(folded, runs)])
                columns = [*batch.columns[:width_of], *[pa.array(v, kind) for v, kind in zip(values, arrow)]]
                names_out = result.names if last else carried.names
                yield pa.RecordBatch.from_arrays(columns if last else [*columns, texts], names=names_out)

        return run

    before, spark = False, docs.sparkSession
    for blocks, last in _passes(benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))):
        shared = [spark.sparkContext.broadcast(block) for block in blocks]
        rows = map_arrow(rows, pass_over(shared, before, last), result if last else carried)
        if not last:
            rows, before = written(rows, "decontamination-pass"), True
            for block in shared:
                block.destroy()
    return rows.toDF(*names, *RESULT.names)


def _passes(items: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """The blocks of each pass and whether it is the last; one pass without blocks for an empty benchmark."""

    def blocks() -> Iterator[tuple]:
        block, held = [], 0
        for row in items.filter("text is not null").toLocalIterator():
            block.append((row["item"], row["text"]))
            held += len(row["text"])
            if held > BLOCK_CHARS:
                yield tuple(block)
                block, held = [], 0
        if block:
            yield tuple(block)

    found, held = blocks(), []
    for block in found:
        if len(held) == PASS_BLOCKS:
            yield held, False
            held = []
        held.append(block)
    yield held, True


def contaminated(n_words: str | Column = "n_words", n_hit: str | Column = "n_hit") -> Column:
    """At least a twentieth of the words, and at least one, lie in windows."""
    words, hit = (F.col(c) if isinstance(c, str) else c for c in (n_words, n_hit))
    return (hit > 0) & (20 * hit >= words)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, as they are, that are not contaminated; no shuffle."""
    found = scan(docs, benchmark, width, text, id, keep=[c for c in docs.columns if c != id])
    return keep_rows(found, docs, id, lambda n_words, n_hit, *_: ~contaminated(n_words, n_hit))
