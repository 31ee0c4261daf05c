"""SimHash near-duplicates: anchors of a covering code bring close fingerprints together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.components import components
from auditlake.llm.workers import map_arrow
from auditlake.session import written

SEED = 42
THRESHOLD = 3  # the anchors below are made for this one
CODE_LENGTH = 31  # the perfect Hamming code of length 2^5 - 1, covering radius 1
SMALL = 32  # anchors of up to so many fingerprints are compared by shifting rows
SAMPLED = 64  # one fingerprint in so many is counted to find large anchors
LARGE = 64  # counted fingerprints from which an anchor is split


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of one text: bit b is set if over half the shingle hashes have it.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are
    ``width`` words with repeats; a shorter text is one shingle, no words give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(x), SEED) for x in zip(*(words[i:] for i in range(width)))]
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, dtype=np.uint64)
    for start in range(0, len(every), 1 << 16):
        bits = np.unpackbits(every[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > len(every), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 3) -> DataFrame:
    """(id, fingerprint bigint) per row; null and empty texts have fingerprint 0."""
    id_type = dict(docs.dtypes)[id]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["_id", "fingerprint"])

    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    return map_arrow(rows, hashed, f"_id {id_type}, fingerprint bigint").withColumnRenamed("_id", id)


def anchors(fingerprint: Column) -> Column:
    """Every anchor within covering radius plus one of either half of a fingerprint.

    Two fingerprints that differ in at most 3 bits differ in at most 1 bit of one
    half. The anchors of a half are the codewords of the perfect Hamming code on
    31 of its bits, times its last bit as it is: covering radius 1. A half goes to
    all anchors within 2 (radius plus its threshold 1), 17 at most: then the
    anchor next to one of the pair is an anchor of both, so no link is lost. With
    2^27 anchors a half, a fingerprint meets few others by chance.
    """
    masks = [sum(1 << (p - 1) for p in range(1, CODE_LENGTH + 1) if p >> k & 1) for k in range(5)]

    def of_half(half: Column, number: int) -> Column:
        word = half.bitwiseAND(F.lit((1 << CODE_LENGTH) - 1))
        syndrome = F.lit(0)
        for k, mask in enumerate(masks):
            syndrome = syndrome + F.pmod(F.bit_count(word.bitwiseAND(F.lit(mask))), F.lit(2)) * (1 << k)
        one = F.lit(1).cast("bigint")

        def flipped(position: Column) -> Column:  # position 0: none
            return F.when(position == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", one, position - 1))

        def pairs(s: Column) -> Column:
            places = F.filter(F.sequence(F.lit(1), F.lit(CODE_LENGTH)), lambda p: p < p.bitwiseXOR(s))
            return F.transform(places, lambda p: half.bitwiseXOR(flipped(p)).bitwiseXOR(flipped(p.bitwiseXOR(s))))

        home = half.bitwiseXOR(flipped(syndrome))
        last = F.lit(1 << CODE_LENGTH)
        near = F.concat(F.array(home, home.bitwiseXOR(last)), F.when(syndrome == 0, F.array().cast("array<bigint>")).otherwise(pairs(syndrome)))
        return F.transform(near, lambda a: a.bitwiseOR(F.lit(number << 32)))

    low = fingerprint.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fingerprint, 32)
    return F.concat(of_half(low, 0), of_half(high, 1))


def _grown(points: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct points, grown breadth first."""
    rest = points
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = []
            for start in range(0, len(front), 64):
                part = front[start : start + 64]
                near = np.bitwise_count(part[:, None] ^ rest[None, :]) <= threshold
                hit = near.any(axis=0)
                if hit.any():
                    parents = part[near[:, hit].argmax(axis=0)]
                    yield parents, rest[hit]
                    reached.append(rest[hit])
                    rest = rest[~hit]
                    if not len(rest):
                        break
            front = np.concatenate(reached) if reached else rest[:0]


def links_at_anchors(anchor: np.ndarray, points: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all points of an anchor which are linked; rows are sorted by anchor.

    Small anchors give all their links, larger ones a spanning forest, so the
    output is linear in the rows.
    """
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    row_sizes = np.repeat(sizes, sizes)
    small = np.flatnonzero((row_sizes > 1) & (row_sizes <= SMALL))
    a, p = anchor[small], points[small]
    for shift in range(1, SMALL):
        same = a[shift:] == a[:-shift]
        if not same.any():
            break
        close = same & (np.bitwise_count(p[shift:] ^ p[:-shift]) <= threshold)
        if close.any():
            yield p[shift:][close], p[:-shift][close]
    for k in np.flatnonzero(sizes > SMALL):
        yield from _grown(np.unique(points[starts[k] : starts[k] + sizes[k]]), threshold)


def fingerprint_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within ``threshold`` bits.

    The links span the same components as all pairs within the threshold. A large
    anchor is split by the bytes of the half that it does not look at: of four, one
    at least is equal where no more than 3 bits differ, so each fingerprint goes to
    its four bytes there and no link is lost. Which anchors are large is found from
    every ``SAMPLED``-th fingerprint by hash; it changes no result. A task streams
    its anchors in order and holds those of one batch and the anchor it is in:
    8 bytes a fingerprint.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover thresholds up to {THRESHOLD}")
    at_anchors = lambda df: df.select("fingerprint", F.explode(anchors(F.col("fingerprint"))).alias("anchor"))
    counted = at_anchors(distinct.filter(F.pmod(F.xxhash64("fingerprint"), F.lit(SAMPLED)) == 0))
    large = counted.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= LARGE).select("anchor", F.lit(True).alias("large"))
    value = F.col("fingerprint")
    other = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned(value, 32)).otherwise(value.bitwiseAND(F.lit(0xFFFFFFFF)))
    bytes_ = [F.shiftright(other, 8 * k).bitwiseAND(F.lit(255)) + (256 * k + 1) for k in range(4)]
    split = F.explode(F.when(F.col("large"), F.array(*bytes_)).otherwise(F.array(F.lit(0).cast("bigint")))).alias("byte")
    split_rows = at_anchors(distinct).join(large, "anchor", "left").select("fingerprint", "anchor", split)
    rows = split_rows.select(F.call_function("shiftleft", F.col("anchor"), F.lit(11)).bitwiseOR(F.col("byte")).alias("anchor"), "fingerprint")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_p = [], []

        def out(anchor, points):
            found = list(links_at_anchors(anchor, points, threshold))
            if found:
                pairs = np.stack([np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])])
                pairs = np.unique(np.sort(pairs, axis=0), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        held = 0
        for batch in batches:
            a, p = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            held_a.append(a)
            held_p.append(p)
            held += len(a)
            if len(a) and held >= 200_000 and a[-1] != held_a[0][0]:
                anchor, points = np.concatenate(held_a), np.concatenate(held_p)
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                yield from out(anchor[:cut], points[:cut])
                held_a, held_p, held = [anchor[cut:]], [points[cut:]], len(anchor) - cut
        if held:
            yield from out(np.concatenate(held_a), np.concatenate(held_p))

    dealt = rows.select("anchor", "fingerprint").repartition("anchor").sortWithinPartitions("anchor")
    return map_arrow(dealt, compared, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 3, threshold: int = THRESHOLD
) -> DataFrame:
    """(id, fingerprint bigint, component_id): each row's class of linked fingerprints.

    Fingerprints link at ``threshold`` or fewer differing bits; ``component_id`` is
    the smallest id reachable, the row's own included. Rows without words have
    fingerprint 0, linked like any other. A null id takes part in the linking but
    is never a ``component_id`` unless no row of the class has an id. Repeated rows
    are one class; an empty table gives no row; other columns are not read.

    Texts never leave the task that reads them. Equal fingerprints are one row
    before anchors are dealt out, so a group of copies costs as much as one text.
    """
    rows = written(fingerprints(docs, text, id, width), "fingerprints")
    distinct = written(rows.groupBy("fingerprint").agg(F.min(id).alias("_least")), "distinct-fingerprints")
    found = components(fingerprint_links(distinct, threshold))
    known = distinct.join(found.hint("merge"), distinct["fingerprint"] == found["node"], "left").select(
        "fingerprint", "_least", F.coalesce("component", "fingerprint").alias("_root")
    )
    known = written(known, "fingerprint-classes")
    roots = known.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = known.join(roots.hint("merge"), "_root").select("fingerprint", "component_id")
    return rows.join(classes.hint("merge"), "fingerprint").select(id, "fingerprint", "component_id")


def clean(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, whose id is the smallest of their class.

    Rows that share an id stand or fall together, and rows without id stay. Only the
    ids of rows to drop are joined; where they are few, texts are not shuffled.
    """
    found = near_duplicates(docs, text, id, width, threshold)
    dropped = found.filter(F.col(id) != F.col("component_id")).select(id)
    return docs.join(dropped, id, "left_anti").select(*docs.columns)
