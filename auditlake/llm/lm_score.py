"""Language-model scores by lattice likelihood.

A text is a path through a lattice of arcs: recurring passages, words, and the
pieces of a subword vocabulary inside words. Its probability is the sum over all
paths, taken by forward recursion in log space. Pieces start from scores that the
vocabulary's ranks imply and are re-estimated once, by expected counts over all
distinct training words. Words and passages have their training counts,
discounted, and what the discount leaves goes to the arcs below:

    lattice(w) = sum over segmentations of w of the product of piece probabilities
    P(w) = max(c(w) - D, 0) / N + D V / N * ((1 - 2e) lattice(w) + e [w is the end] + e [w is a line break])
    P(p) = max(c(p) - D', 0) / M + D' V' / M * product of P(w) over the words of p

A passage ends at every sentence end and every line break. A sentence ends where
a word ends in a sentence mark of any script, closing quotes and brackets
included, and after the marks beyond ASCII also inside what white space leaves
one word (Chinese, Japanese). Words cut there are units of their own for the
lattice; a line break without a mark before it is a token of the passage it
ends, the end of a text closes its last line and is a passage of its own. The
base score knows nothing of this: it counts words. Each level sums to 1.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from auditlake.llm.workers import map_arrow
from auditlake.session import written

FREQUENT = 200_000  # words whose scores every task holds; all others are joined
ROW = 64  # longer words have a recursion of their own
END_SHARE = 0.001  # of the lattice's distribution, for the end of a text and for a line break each
JOINED_SHARE = 0.5  # of a unit that ends in a mark beyond ASCII, without white space after it
FLUSH = 400_000  # distinct words a task counts before it passes them on
SPACE = b" \t\n\x0b\x0c\r"
BREAK = b"\n"  # a line break as a token
JOINED = b"\v"  # ends a unit that its word goes on after
# Unicode's sentence terminals beyond ASCII, ellipsis, Greek question mark, line and paragraph separators; closing marks.
MARKS = "".join(
    chr(c)
    for x in (
        "37E 589 61D-61F 6D4 700-702 7F9 837 839 83D-83E 964-965 104A-104B 1362 1367-1368 166E 1735-1736 17D4-17D5 1803 1809 1944-1945 "
        "1AA8-1AAB 1B5A-1B5B 1B5E-1B5F 1B7D-1B7F 1C3B-1C3C 1C7E-1C7F 2026 203C-203D 2047-2049 2E2E 2E3C 2E53-2E54 3002 A4FF A60E-A60F "
        "A6F3 A6F7 A876-A877 A8CE-A8CF A92F A9C8-A9C9 AA5D-AA5F AAF0-AAF1 ABEB FE52 FE56-FE57 FF01 FF0E FF1F FF61 10A56-10A57 10F55-10F59 "
        "10F86-10F89 11047-11048 110BE-110C1 11141-11143 111C5-111C6 111CD 111DE-111DF 11238-11239 1123B-1123C 112A9 1144B-1144C "
        "115C2-115C3 115C9-115D7 11641-11642 1173C-1173E 11944 11946 11A42-11A43 11A9B-11A9C 11C41-11C42 11EF7-11EF8 11F43-11F44 "
        "16A6E-16A6F 16AF5 16B37-16B38 16B44 16E98 1BC9F 1DA88 85 2028-2029"
    ).split()
    for c in range(int(x.split("-")[0], 16), int(x.split("-")[-1], 16) + 1)
)
CLOSING = "\"')]}»›”’」』】）］｝〉》〕"
SENTENCE_END = re.compile(f"[.!?{MARKS}][.!?{MARKS}{re.escape(CLOSING)}]*+")
BEYOND = re.compile(f"[{MARKS}]")
PLAIN_END = re.compile(f"[.!?][.!?{re.escape(CLOSING)}]*+(?=[ \t\n]|\\Z)")  # where no mark beyond ASCII occurs
GATHERED = 30_000  # words that the lattice reads at once


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _passage_hash(units: list[bytes]) -> int:
    return xxh64_intdigest(b" ".join(units)) - (1 << 63)


def _hashes(piece: bytes) -> int:
    value = 0
    for byte in piece:
        value = (value * 0x100000001B3 + byte + 1) & 0xFFFFFFFFFFFFFFFF
    return value


@dataclass
class Vocabulary:
    """Pieces that start a word (with the space before it) and pieces inside words, with log probabilities.

    Either kind sums to 1, the inner ones together with the end of a word.
    """

    pieces: list[bytes]
    logs: np.ndarray
    end: float

    def __post_init__(self):
        self.longest = max(map(len, self.pieces))
        size = 1 << 18
        while size < 4 * len(self.pieces):
            size *= 2
        self.bits = np.uint64(64 - size.bit_length() + 1)
        self.slots = np.full(size, -1, np.int32)
        self.keys = np.array([_hashes(p) for p in self.pieces], np.uint64)
        for k, slot in enumerate(self._slot(self.keys).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % size
            self.slots[slot] = k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces of some hashes, -1: none."""
        slot = self._slot(keys)
        found = self.slots[slot]
        rest = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.slots)
            found[rest] = self.slots[slot[rest]]
            rest = rest[(found[rest] >= 0) & (self.keys[found[rest]] != keys[rest])]
        return found

    def arcs(self, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Length k and, for each row, the piece (or -1) of each k consecutive bytes of ``raw`` (rows x n)."""
        wide = raw.astype(np.uint64) + np.uint64(1)
        n = raw.shape[1]
        key = np.zeros((len(raw), n), np.uint64)
        for k in range(1, min(self.longest, n) + 1):
            key = key[:, : n - k + 1] * np.uint64(0x100000001B3) + wide[:, k - 1 :]
            yield k, self.find(key.ravel()).reshape(key.shape)

    def _rows(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, bytes) of words of one length, with the space before, some thousand at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes[sizes < ROW]).tolist():
            which = np.flatnonzero(sizes == n)
            for start in range(0, len(which), 1 << 13):
                part = which[start : start + (1 << 13)]
                joined = b" " + b" ".join(words[k] for k in part)
                yield part, np.frombuffer(joined, np.uint8).reshape(len(part), n + 1)
        for k in np.flatnonzero(sizes >= ROW):
            yield np.array([k]), np.frombuffer(b" " + words[k], np.uint8).reshape(1, -1)

    def _forward(self, raw: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        n = raw.shape[1]
        logs = np.append(self.logs, -np.inf)
        lattice = [(k, piece, logs[piece]) for k, piece in self.arcs(raw) if (piece >= 0).any()]  # lengths that occur
        alpha = np.full((len(raw), n + 1), -np.inf)
        alpha[:, 0] = 0.0
        if len(raw) > 1 or n <= ROW:
            for at in range(1, n + 1):
                for k, _, score in lattice:
                    if k > at:
                        break
                    np.logaddexp(alpha[:, at], alpha[:, at - k] + score[:, at - k], out=alpha[:, at])
        else:
            longest = lattice[-1][0]
            table = np.full((n + 1, longest), -np.inf)  # by end and length
            for k, _, score in lattice:
                table[k:, k - 1] = score[0]
            line = np.r_[np.full(longest, -np.inf), np.zeros(1), np.empty(n)]
            for at in range(1, n + 1):
                paths = line[at : at + longest][::-1] + table[at]
                top = paths.max()
                line[at + longest] = top + math.log(np.exp(paths - top).sum()) if top > -np.inf else top
            alpha[0] = line[longest:]
        return alpha, lattice

    def log_likelihoods(self, words: list[bytes]) -> np.ndarray:
        """The log probability of each word, over all its segmentations."""
        result = np.full(len(words), -np.inf)
        for part, raw in self._rows(words):
            result[part] = self._forward(raw)[0][:, -1] + self.end
        return result

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over the words, by forward and backward sums."""
        total = np.zeros(len(self.pieces) + 1)
        for part, raw in self._rows(words):
            alpha, lattice = self._forward(raw)
            n = raw.shape[1]
            beta = np.full((len(raw), n + 1), -np.inf)
            beta[:, n] = 0.0
            for at in range(n - 1, -1, -1):
                for k, _, score in lattice:
                    if k > n - at:
                        break
                    np.logaddexp(beta[:, at], beta[:, at + k] + score[:, at], out=beta[:, at])
            whole = alpha[:, -1:]
            for k, piece, score in lattice:
                share = np.exp(alpha[:, : n - k + 1] + score + beta[:, k:] - whole)
                total += np.bincount(piece.ravel(), share.ravel(), len(total)) if (piece >= 0).all() else np.bincount(
                    np.where(piece < 0, len(self.pieces), piece).ravel(), share.ravel(), len(total)
                )
        return total[:-1]


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a rank file (base64 and rank a line) with scores falling as 1 / rank."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    space = set(SPACE)
    single = {bytes([b]) for b in range(256)}
    ranks = {**dict.fromkeys(single - ranks.keys(), len(ranks)), **ranks}
    usable = [p for p in ranks if not space.intersection(p[1:]) and (p[0] == 0x20 or p[0] not in space)]
    return estimated(usable, np.array([1.0 / (ranks[p] + 100) for p in usable]), 0.2)


def estimated(pieces: list[bytes], weights: np.ndarray, end: float) -> Vocabulary:
    first = np.array([p[0] == 0x20 for p in pieces])
    sums = np.where(first, weights[first].sum(), weights[~first].sum())
    return Vocabulary(pieces, np.log(weights / sums) + np.where(first, 0.0, math.log(1 - end)), math.log(end))


def passages_of(text: str | None) -> list[list[bytes]]:
    """The units of each passage of a text; its end, a passage of its own, is left out.

    Units are the words but where a sentence ends inside a word, and the token ``BREAK``.
    """
    text = (text or "").replace("\r", "\n").replace("\v", "\n").replace("\f", "\n")
    if text.isascii() or set(text).isdisjoint(MARKS):
        marked = PLAIN_END.sub("\\g<0>\r", text)
    else:
        marked = _marked(text)
    parts = []
    for line in marked.encode("utf-8", "surrogatepass").lower().split(b"\n"):
        *ended, rest = line.split(b"\r")
        for sentence in ended:
            units = sentence.split()
            if sentence.endswith(JOINED):
                units[-1] += JOINED
            parts.append(units)
        if units := rest.split():
            parts.append([*units, BREAK])
    return parts


def _marked(text: str) -> str:
    """The text with a carriage return behind each sentence, marks of any script."""

    def end(found: re.Match) -> str:
        mark, after = found[0], text[found.end() : found.end() + 1]
        if not after or after in " \t\n":
            return mark + "\r"
        return mark + "\v\r" if not mark.isascii() and BEYOND.search(mark) else mark

    return SENTENCE_END.sub(end, text)


def _joined(parts: list[list[bytes]]) -> bool:
    """Whether a sentence ends inside a word."""
    return any(units[-1].endswith(JOINED) for units in parts)


def unit_logs(model: Vocabulary, units: list[bytes]) -> np.ndarray:
    """The log probability of each unit below the counts; the end of a text has what is missing to 1."""
    plain = [u.removesuffix(JOINED) for u in units]
    logs = model.log_likelihoods(plain) + math.log(1 - 2 * END_SHARE)
    for k, unit in enumerate(units):
        if unit == BREAK:
            logs[k] = math.log(END_SHARE)
        elif not unit.isascii():
            text = plain[k].decode("utf-8", "surrogatepass")
            if BEYOND.search(text, len(text.rstrip(".!?" + MARKS + CLOSING))):
                logs[k] += math.log(JOINED_SHARE if unit.endswith(JOINED) else 1 - JOINED_SHARE)
    return logs


def token_counts(docs: DataFrame, train: str, text: str = "text") -> DataFrame:
    """(word binary, passage bigint, c, u): words and passages with their counts where ``train`` holds.

    A row has a word or the hash of a passage. ``c`` counts a word as a word (or the
    passage), ``u`` as a unit. Words and units of other rows have count 0.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: Counter[bytes] = Counter()
        more: Counter[bytes] = Counter()  # words less units, where they differ
        passages: Counter[int] = Counter()
        others: set[bytes] = set()

        def out():
            words = [*units, *others.union(more).difference(units)]
            hashes = pa.array(list(passages), pa.int64())
            word = pa.concat_arrays([pa.array(words, pa.binary()), pa.nulls(len(hashes), pa.binary())])
            passage = pa.concat_arrays([pa.nulls(len(words), pa.int64()), hashes])
            c = pa.array([*(0 if w == BREAK else units[w] + more[w] for w in words), *passages.values()], pa.int64())
            u = pa.array([*(units[w] for w in words), *[0] * len(hashes)], pa.int64())
            for x in (units, more, passages, others):
                x.clear()
            return pa.RecordBatch.from_arrays([word, passage, c, u], names=["word", "passage", "c", "u"])

        for batch in batches:
            for value, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                value = value.as_py()
                parts = passages_of(value)
                joined = _joined(parts)
                if learn:
                    passages.update(map(_passage_hash, parts))
                    for part in parts:
                        units.update(part)
                    if joined:
                        more.update(words_of(value))
                        for part in parts:
                            more.subtract(part)
                else:
                    for part in parts:
                        others.update(part)
                    if joined:
                        others.update(words_of(value))
                if len(units) + len(more) + len(others) + len(passages) > FLUSH:
                    yield out()
        yield out()

    source = docs.select(F.col(text).alias("t"), F.col(train).alias("train"))
    rows = map_arrow(source, counted, "word binary, passage bigint, c bigint, u bigint")
    return rows.groupBy("word", "passage").agg(F.sum("c").alias("c"), F.sum("u").alias("u"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``GATHERED`` or more, the last one aside."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _discount(counts: DataFrame, c: str = "c") -> tuple[int, int, float]:
    """(sum, kinds above 0, discount) of a column of counts; the discount from the kinds met once and twice."""
    of = lambda n: F.sum((F.col(c) == n).cast("bigint"))
    found = [x or 0 for x in counts.agg(F.sum(c), F.sum((F.col(c) > 0).cast("bigint")), of(1), of(2)).head()]
    return found[0], found[1], found[2] / (found[2] + 2 * found[3]) if found[2] and found[3] else 0.5


def _log_sum(a: Column, b: Column) -> Column:
    """log10(10^a + 10^b); ``a`` may be null for none."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(a.isNull(), b).otherwise(high + F.log10(1 + F.pow(F.lit(10.0), low - high)))


def score(docs: DataFrame, path: str, train: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score, lattice_score) per row.

    ``train`` names a boolean column: rows to learn from (null: not). ``score`` is
    the model's log10 probability of the whole text, ``lattice_score`` that of the
    subword lattice alone, over all segmentations by the vocabulary's scores,
    ``base_score`` that of counts with 0.1 added. Null and empty texts are one end. Repeated rows count and are
    scored each; without rows to learn from, the lattice alone scores; an empty
    table gives no row; other columns are not read.

    Texts stay in the tasks that read them. Counts are combined before they are
    shuffled, passages by a 64-bit hash. The ``FREQUENT`` most frequent words' scores go to every task;
    the other words of a text are joined with their scores: same result, since
    which way a word goes changes nothing in it.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id]
    source = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    counts = written(token_counts(source, "_train", "_text"), "token-counts")
    words = counts.filter(F.col("word").isNotNull()).select("word", "c", "u")
    passages = counts.filter(F.col("passage").isNotNull()).select("passage", "c")
    word_tokens, known, _ = _discount(words)
    unit_tokens, unit_kinds, discount = _discount(words, "u")
    n_passages, passage_kinds, passage_discount = _discount(passages)
    trained = source.filter("_train").count()
    tokens, kinds = word_tokens + trained, known + (trained > 0)
    n_units, unit_kinds = unit_tokens + trained, unit_kinds + (trained > 0)
    n_passages, passage_kinds = n_passages + trained, passage_kinds + (trained > 0)

    pieces = vocabulary(path)
    start = spark.sparkContext.broadcast((pieces.pieces, pieces.logs, pieces.end))  # the vocabulary: a few MB

    def expectations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary(*start.value)
        total = np.zeros(len(model.pieces))
        for batch in _gathered(batches):
            total += model.expected([w.removesuffix(JOINED) for w in batch.column(0).to_pylist()])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    learned = map_arrow(words.filter((F.col("u") > 0) & (F.col("word") != F.lit(BREAK))).select("word"), expectations, "piece bigint, uses double")
    uses = np.zeros(len(pieces.pieces))
    for row in learned.groupBy("piece").agg(F.sum("uses").alias("uses")).toLocalIterator():  # one row a piece
        uses[row["piece"]] = row["uses"]
    inner = uses[[p[0] != 0x20 for p in pieces.pieces]].sum()
    pieces = estimated(pieces.pieces, uses + 20 * np.exp(pieces.logs) + 1e-3, (unit_kinds + 1) / (unit_kinds + inner + 5))
    model = spark.sparkContext.broadcast((pieces.pieces, pieces.logs, pieces.end))

    back_off = discount * unit_kinds / n_units if n_units else 1.0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Vocabulary(*model.value)
        for batch in _gathered(batches):
            logs = unit_logs(lattice, batch.column(0).to_pylist())
            u = batch.column(2).to_numpy()
            with np.errstate(divide="ignore"):
                counted = np.log(np.maximum(u - discount, 0) / max(n_units, 1))
            total = np.logaddexp(counted, logs + math.log(back_off)) / math.log(10)
            columns = [*batch.columns, pa.array(total), pa.array(logs / math.log(10))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "c", "u", "log", "lattice"])

    lexicon = written(map_arrow(words, scored, "word binary, c bigint, u bigint, log double, lattice double"), "word-scores")
    base_all = math.log10(tokens + 0.1 * (kinds + 1))
    is_word = F.col("word") != F.lit(BREAK)
    base = F.when(is_word, F.log10(F.col("c") + 0.1) - F.lit(base_all)).otherwise(0.0).alias("base")
    known_word = (is_word & (F.col("c") > 0)).cast("bigint").alias("known")
    lexicon = lexicon.select("word", base, "log", known_word, "lattice", F.greatest("c", "u").alias("c"))
    top = lexicon.orderBy(F.desc("c"), "word").limit(FREQUENT).drop("c").toArrow()
    held = [top[c].to_numpy() for c in ("base", "log", "known", "lattice")]
    frequent = spark.sparkContext.broadcast((dict(zip(top["word"].to_pylist(), range(len(top)))), *held))
    end = max(trained - discount, 0) / max(n_units, 1) + back_off * END_SHARE
    left_over = passage_discount * passage_kinds / n_passages if n_passages else 1.0
    end_log = math.log10(max(trained - passage_discount, 0) / max(n_passages, 1) + left_over * end)
    end_base, end_known = math.log10(trained + 0.1) - base_all, int(trained > 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, *columns = frequent.value
        base_of, log_of, known_of, lattice_of = (np.append(c, 0) for c in columns)  # the last for words not held
        task, number = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            texts = [value.as_py() for value in batch.column(1)]
            n, parsed = len(texts), [passages_of(t) for t in texts]
            parts = [part for of in parsed for part in of]
            units = list(chain.from_iterable(parts))
            at = np.fromiter(map(index.get, units, repeat(-1)), np.int64, len(units))
            n_parts = np.fromiter(map(len, parsed), np.int64, n)
            part_of = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
            text_of_part = np.repeat(np.arange(n), n_parts)
            text_of, first = text_of_part[part_of], np.cumsum(n_parts) - n_parts
            logs = np.bincount(part_of, log_of[at], len(parts))
            base = end_base + np.bincount(text_of, base_of[at], n)
            found = end_known + np.bincount(text_of, known_of[at], n).astype(np.int64)
            lattice = math.log10(END_SHARE) + np.bincount(text_of, lattice_of[at], n)
            broken = np.fromiter((part[-1] == BREAK for part in parts), bool, len(parts))
            n_tokens = 1 + np.bincount(text_of, minlength=n) - np.bincount(text_of_part, broken, n).astype(np.int64)
            joined = np.fromiter(map(_joined, parsed), bool, n)

            missed = np.flatnonzero(at < 0)
            rest = [units[k] for k in missed]
            owner, place = text_of[missed], part_of[missed] - first[text_of[missed]]
            as_word = ~joined[owner] & np.fromiter((unit != BREAK for unit in rest), bool, len(rest))
            as_unit = np.ones(len(rest), bool)
            for k in np.flatnonzero(joined).tolist():  # words differ from units
                words = words_of(texts[k])
                own = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                n_tokens[k], base[k], found[k] = 1 + len(words), end_base + base_of[own].sum(), end_known + int(known_of[own].sum())
                more = [words[x] for x in np.flatnonzero(own < 0)]
                rest += more
                owner, place = np.append(owner, np.full(len(more), k)), np.append(place, np.zeros(len(more), np.int64))
                as_word, as_unit = np.append(as_word, np.ones(len(more), bool)), np.append(as_unit, np.zeros(len(more), bool))
            order = np.argsort(owner, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
            listed = [pa.array(rest, pa.binary()).take(pa.array(order)), *[pa.array(x.astype(np.int64)[order]) for x in (as_word, as_unit, place)]]
            part_ends = np.r_[0, np.cumsum(n_parts)].astype(np.int32)
            hashes = pa.array([_passage_hash(part) for part in parts], pa.int64())
            columns = [
                *(pa.array(x) for x in (task + number + np.arange(n), n_tokens, found, base, lattice)),
                *(pa.ListArray.from_arrays(pa.array(part_ends), x) for x in (hashes, pa.array(logs))),
                *(pa.ListArray.from_arrays(pa.array(ends), x) for x in listed),
            ]
            number += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=names)

    names = ["_id", "_train", "row", "n_tokens", "n_known", "base", "lattice", "hashes", "logs", "words", "counts", "uses", "places"]
    schema = f"""_id {id_type}, _train boolean, row bigint, n_tokens bigint, n_known bigint, base double, lattice double, hashes array<bigint>,
        logs array<double>, words array<binary>, counts array<bigint>, uses array<bigint>,
        places array<bigint>"""
    rows = written(map_arrow(source.select("_id", "_text", "_train"), read, schema), "frequent-scores")

    zipped = F.explode(F.arrays_zip("words", "counts", "uses", "places"))
    rest = rows.select("row", zipped.alias("x")).select(
        "row", F.col("x.places").alias("place"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"), F.col("x.uses").alias("u")
    )
    n = F.col("n")
    more = F.struct("place", (F.col("u") * F.col("log")).alias("log"))
    rest = rest.join(lexicon.drop("c"), "word").groupBy("row").agg(
        F.sum(n * F.col("known")).alias("more_known"),
        F.sum(n * F.col("base")).alias("more_base"),
        F.sum(F.col("u") * F.col("lattice")).alias("more_lattice"),
        F.collect_list(more).alias("more"),
    )  # one row a text, no longer than the text
    filled = written(rows.drop("words", "counts", "uses", "places").join(rest, "row", "left"), "filled-scores")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, sizes = batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy()
            logs = batch.column(2).flatten().to_numpy().copy()
            starts = np.cumsum(sizes) - sizes
            held = pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy()
            places, logs_of = batch.column(3).flatten().flatten()
            np.add.at(logs, np.repeat(starts, held) + places.to_numpy(), logs_of.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, sizes)), batch.column(1).flatten(), pa.array(logs)], names=["row", "passage", "log"])

    parts = map_arrow(filled.select("row", "hashes", "logs", "more").filter(F.size("hashes") > 0), dealt, "row bigint, passage bigint, log double")
    counted_log = F.log10((F.col("c") - F.lit(passage_discount)) / F.lit(float(max(n_passages, 1))))
    left = F.lit(math.log10(left_over))
    sums = (
        parts.join(passages, "passage", "left")
        .select("row", _log_sum(counted_log, left + F.col("log")).alias("part_log"))
        .groupBy("row")
        .agg(F.sum("part_log").alias("score"))
    )
    whole = filled.select("_id", "_train", "row", "n_tokens", "n_known", "base", "lattice", "more_known", "more_base", "more_lattice").join(sums, "row", "left")
    return whole.select(
        F.col("_id").alias(id),
        F.col("_train").alias("train"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.coalesce("score", F.lit(0.0)) + F.lit(end_log)).alias("score"),
        (F.col("lattice") + F.coalesce("more_lattice", F.lit(0.0))).alias("lattice_score"),
    )
