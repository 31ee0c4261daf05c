"""Spelling variants: pairs of words one edit apart, found by blocked Gram matrices.

A word is a row of letter counts. The Gram matrix of a block of rows gives all
squared distances of the block at once, |x|^2 + |y|^2 - 2 xy: one inserted or
deleted letter is at distance 1, a replaced one at most at 2. What is nearer than
that is verified letter by letter. Blocks hold words of one length and the next
one that also share one half: of two words one edit apart, what lies before the
edit or what lies after it is the same for both.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.workers import map_arrow
from auditlake.session import written

FLUSH = 400_000  # distinct words a task counts before it passes them on
CELLS = 1 << 16  # letters of one half-block: larger blocks are cut and their parts compared pair by pair
LEAST_PART = 16  # words of a part, at least, however long they are
STRIP = 1 << 20  # cells of a Gram matrix held at once
HELD = 1 << 20  # letters a task gathers before it compares

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Letters of a run by place: A-Z, a-z and U+00C0 to U+00FF, which are the code points of Latin-1 from there on.
_PLACE = np.zeros(256, np.uint8)
_PLACE[0x41:0x5B] = _PLACE[0x61:0x7B] = np.arange(1, 27)
_PLACE[0xC0:0x100] = np.arange(27, 91)
PLACES = 91  # 0: none


def words_of(id: object, text: str | None, least: int, modulus: int) -> Counter[str]:
    """The words of a text with their counts, runs of ``least`` or more letters.

    A run whose crc32 with the id is divisible by ``modulus`` loses one letter.
    """
    runs = re.findall("[A-Za-zÀ-ÿ]{%d,}" % least, text or "")
    counts: Counter[str] = Counter()
    for run, n in Counter(runs).items():
        word = run.lower() if run.isascii() else run.translate(LOWER)
        number = zlib.crc32(f"{id}:{word}".encode())
        if number % modulus == 0:
            at = number % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        counts[word] += n
    return counts


def word_counts(docs: DataFrame, text: str, id: str, least: int = 7, modulus: int = 31) -> DataFrame:
    """(word, n) of all rows; counts are combined in the tasks before they are shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            found = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(found, names=["word", "n"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.update(words_of(key, value.as_py(), least, modulus))
                if len(counts) > FLUSH:
                    yield out()
        yield out()

    rows = map_arrow(docs.select(F.col(id).cast("string"), F.col(text)), counted, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def blocks(words: DataFrame) -> DataFrame:
    """(length, half, key, i, j, side, word, n): the rows of each product.

    Block L holds the words of L letters and those of L + 1, once by their first
    L // 2 letters and once by their last L - L // 2. A block of more than ``CELLS``
    letters is cut into parts, and each pair of parts (i, j) is a product.
    """
    size = F.char_length("word")
    base, longer = F.struct(size.alias("length"), F.lit(0).alias("step")), F.struct((size - 1).alias("length"), F.lit(1).alias("step"))
    placed = words.select("word", "n", F.explode(F.array(base, longer)).alias("b")).select("word", "n", "b.length", "b.step")
    first = F.expr("length div 2").cast("int")
    last = F.col("length") - first
    keyed = placed.select(
        "word",
        "n",
        "length",
        "step",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("half"), F.substring(F.col("word"), F.lit(1), first).alias("key")),
                F.struct(F.lit(1).alias("half"), F.substring(F.col("word"), size - last + 1, last).alias("key")),
            )
        ).alias("x"),
    ).select("word", "n", "length", "step", "x.half", "x.key")
    block = ["length", "half", "key"]
    counts = keyed.groupBy(block).agg(F.sum(1 - F.col("step")).alias("bases"), F.count("*").alias("rows"))
    part = F.greatest(F.lit(LEAST_PART), F.floor(F.lit(CELLS) / F.col("length")))
    parts = F.ceil(F.col("rows") / part).cast("int").alias("parts")
    dealt = keyed.join(counts.filter("bases > 0 AND rows > 1").select(*block, parts), block)
    own = F.pmod(F.xxhash64("word", F.lit("part")), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(F.least(p, F.col("own")).alias("i"), F.greatest(p, F.col("own")).alias("j")),
    )
    spread = dealt.withColumn("own", own).select(*block, "step", "word", "n", "own", F.explode(pairs).alias("p"))
    return spread.select(*block, "p.i", "p.j", (2 * (F.col("own") != F.col("p.i")).cast("int") + F.col("step")).alias("side"), "word", "n")


def near(letters: np.ndarray, norms: np.ndarray, rows: np.ndarray, columns: np.ndarray, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of ``rows``, of ``columns``) of letter counts at squared distance 2 or less; ``triangle``: each pair once."""
    others, lengths = letters[columns].T, norms[columns]
    step = max(1, STRIP // max(1, len(columns)))
    for start in range(0, len(rows), step):
        part = rows[start : start + step]
        distance = norms[part][:, None] + lengths - 2 * (letters[part] @ others)
        a, b = np.nonzero(distance < 2.5)
        if triangle:
            once = b > a + start
            a, b = a[once], b[once]
        yield part[a], columns[b]


def one_edit(codes: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, longer: bool, half: int) -> np.ndarray:
    """Which pairs differ by one edit; ``b`` is one letter longer or as long as ``a``.

    A pair with an inserted letter whose two halves both agree belongs to half 0.
    """
    x, y = codes[a, :length], codes[b]
    same = x == y[:, :length]
    if not longer:
        return (~same).sum(axis=1) == 1
    after = x == y[:, 1 : length + 1]
    before = np.where(same.all(axis=1), length, same.argmin(axis=1))
    behind = np.where(after.all(axis=1), length, after[:, ::-1].argmin(axis=1))
    fits = before + behind >= length
    if half:
        fits &= before < length // 2
    return fits


def links(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of distinct words one edit apart, either way round.

    ``words``: (word, n), words distinct, of letters up to U+00FF. Each product is
    held by one task, at most two parts of a block, and compared in strips.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cells = 0

        def out(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lengths = rows.column("length").to_numpy()
            for start, end in _spans(np.flatnonzero(np.diff(lengths)) + 1, len(lengths)):
                yield from _linked(rows.slice(start, end - start), int(lengths[start]))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            cells += batch.num_rows * (batch.column("length")[batch.num_rows - 1].as_py() + 1)
            if cells > HELD:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(_starts(rows)[-1]) if len(_starts(rows)) else 0  # the last product may go on
                if cut:
                    yield from out(rows.slice(0, cut))
                held = [rows.slice(cut)]
                cells = held[0].num_rows * (held[0].column("length")[0].as_py() + 1)
        if held:
            yield from out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    product = ["length", "half", "key", "i", "j"]
    dealt = blocks(words).repartition(*product).sortWithinPartitions(*product)
    return map_arrow(dealt, compared, "word string, n bigint, near string, near_n bigint")


def _spans(starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    edges = [0, *starts.tolist(), size]
    return zip(edges[:-1], edges[1:])


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where products begin in rows sorted by product, the first one left out."""
    new = np.zeros(max(0, rows.num_rows - 1), bool)
    for name in ("length", "half", "i", "j"):
        new |= np.diff(rows.column(name).to_numpy()) != 0
    keys = rows.column("key")
    new |= pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(codes), PLACES), np.float32)
    for start in range(0, len(codes), step := max(1, (1 << 18) // codes.shape[1])):
        part = _PLACE[codes[start : start + step]]
        flat = part + PLACES * np.arange(len(part))[:, None]
        counts[start : start + step] = np.bincount(flat.ravel(), minlength=PLACES * len(part)).reshape(-1, PLACES)
    counts[:, 0] = 0
    return counts


def _linked(rows: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """The links within the products of some rows, all of one length."""
    half, side, i, j, n = (rows.column(k).to_numpy() for k in ("half", "side", "i", "j", "n"))
    words = rows.column("word")
    codes = np.array([w.encode("latin-1") for w in words.to_pylist()], f"S{length + 1}").view(np.uint8).reshape(len(words), -1)
    letters = _letter_counts(codes)
    norms = np.einsum("ij,ij->i", letters, letters)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for first, end in _spans(_starts(rows), len(words)):
        if end - first < 2:
            continue
        sides = [first + np.flatnonzero(side[first:end] == s) for s in range(4)]
        for s, t in [(0, 0), (0, 1)] if i[first] == j[first] else [(0, 2), (0, 3), (2, 1)]:  # bases with bases and with longer words
            if len(sides[s]) and len(sides[t]):
                for a, b in near(letters, norms, sides[s], sides[t], s == t):
                    right = one_edit(codes, a, b, length, t % 2 == 1, int(half[first]))
                    found.append((a[right], b[right]))
    if found:
        a, b = (np.concatenate(x) for x in zip(*found))
        a, b = np.r_[a, b], np.r_[b, a]
        columns = [words.take(pa.array(a)), pa.array(n[a]), words.take(pa.array(b)), pa.array(n[b])]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "near_n"])


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root): the last form that following forms ``2 ** steps`` times reaches."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = written(
            found.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots"
        )
    return found


def variants(
    docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = 7, times: int = 2, ratio: int = 10, modulus: int = 31
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with the spelling it is a variant of.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased,
    one letter deleted from runs whose crc32 with the row's id (null: ``None``) is
    divisible by ``modulus``; those of ``least`` letters and ``times`` occurrences
    count. Near words differ by one edit. ``form``: the near word of most
    occurrences, ties to the smallest, if it has ``ratio`` times as many, else null.
    ``root`` follows forms to the last one, the word itself if it has none.

    Null and empty texts have no words; repeated rows count as often as they occur;
    an empty table gives no row; other columns are not read, so no name clashes.
    Every pair of words that can be one edit apart meets in some product, whatever
    the size of a block. Forms at least multiply occurrences, so a chain has no more
    links than the largest count has digits.
    """
    counts = word_counts(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_text", "_id", least, modulus)
    words = written(counts.filter(F.col("n") >= times), "spelling-words")
    found = written(links(words), "spelling-links")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    nearest = found.groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(nearest, "word", "left")
    formed = (-F.col("best.n")) >= ratio * F.col("n")
    shaped = written(
        known.select(
            "word",
            F.when(formed, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(formed, -F.col("best.n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    forms = shaped.filter(F.col("form").isNotNull()).select("word", "form")
    largest = shaped.agg(F.max("form_n")).head()[0] or 1
    roots = _roots(forms, len(str(largest)).bit_length())
    return shaped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(form: str | Column = "form") -> Column:
    """Whether a word has a form that is much more common."""
    return (F.col(form) if isinstance(form, str) else form).isNotNull()
