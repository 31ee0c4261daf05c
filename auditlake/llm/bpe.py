"""Byte-level BPE encoding and decoding with segment trees over adjacent pair ranks.

A piece of n bytes starts as n tokens; leaf i of a tree holds the rank of the
pair that starts at token i, with i in its low bits, so the root is the leftmost
pair of lowest rank. A merge changes three leaves; each is updated up to the root
in log n steps. Short pieces are merged many at a time, one tree a row of numpy
arrays; longer ones have a tree of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.workers import map_arrow

# The public pattern of byte-level pieces, with Unicode white space
# written out, and the printable bytes that stand for themselves in its alphabet.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]

NONE = np.int32((1 << 31) - 1)
ROW_BYTES = 64  # longer pieces get a tree of their own
WIDE_ASCII = ["  ", " \n", " \t", " \r", " \v", " \f"]
MARKS = ".,;:!?"
KEPT = 400_000  # segments a worker remembers between batches, each of at most KEPT_CHARS
KEPT_CHARS = 64


def _alphabet() -> dict[str, int]:
    """The character of each byte: itself if printable, else the next one from 256 on."""
    own = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """The tokenizer of one vocabulary file (the JSON of a byte-level BPE)."""

    def __init__(self, spec: bytes, decoder: bool = False):
        """``decoder``: only what decoding needs."""
        read = json.loads(spec)
        alphabet = _alphabet()
        vocab = read["model"]["vocab"]
        added = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, number in vocab.items():
            if token not in added:
                self.token_bytes[number] = bytes(alphabet[c] for c in token)
        for token, number in added.items():
            self.token_bytes[number] = token.encode()
        self.size = size
        self.added = {token: np.array([number], "<u4").tobytes() for token, number in added.items()}
        if decoder:
            return
        merges = [m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"]]
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in alphabet.items():
            self.byte_ids[byte] = vocab[char]
        if len(merges) * ROW_BYTES >= NONE or size >= 1 << 16:
            raise ValueError("vocabularies of up to 65535 tokens fit the trees")
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._hash_pairs(keys)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.merged_list = self.merged.tolist()
        longest_first = sorted(map(regex.escape, added), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(longest_first) + ")") if added else None
        self.pieces = regex.compile(PIECES)
        self.wide_space = regex.compile(f" [{SPACE}]")
        self.after_space: dict[str, bytes] = {}  # ids of " " + segment
        self.plain: dict[str, bytes] = {}

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """Pair keys in a table of open addressing, a tenth full: most look-ups are one probe."""
        bits = max(10, (10 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.slot_keys = np.zeros(1 << bits, np.uint32)
        self.slot_ranks = np.full(1 << bits, NONE, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.slot_ranks[slot] != NONE:
                slot = (slot + 1) & self.mask
            self.slot_keys[slot], self.slot_ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) * np.uint32(self.size) + right.astype(np.uint32)
        slot = self._slots(key)
        ranks = self.slot_ranks[slot]
        rest = np.flatnonzero((ranks != NONE) & (self.slot_keys[slot] != key))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            ranks[rest] = self.slot_ranks[slot[rest]]
            rest = rest[(ranks[rest] != NONE) & (self.slot_keys[slot[rest]] != key[rest])]
        return ranks

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` (a power of 2, up to 64) bytes: one tree a row.

        All arrays are flat: row k starts at ``k * width``, its tree at twice that.
        """
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        columns = np.arange(width)
        inside = (columns < sizes[:, None]).ravel()
        ids = np.zeros(n * width, np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.where(columns + 1 < sizes[:, None], columns + 1, width).astype(np.int32).ravel()
        before = np.broadcast_to(columns - 1, (n, width)).astype(np.int32).ravel()
        alive = inside.copy()
        tree = np.full((n, 2 * width), NONE, np.int32)
        places = np.flatnonzero((after < width) & inside)  # places that start a pair
        ranks = self._pair_ranks(ids[places], ids[places + 1])
        at = (places % width).astype(np.int32)
        tree[places // width, width + at] = np.where(ranks == NONE, NONE, np.where(ranks == NONE, 0, ranks) * np.int32(ROW_BYTES) + at)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        flat, levels = tree.ravel(), width.bit_length() - 1

        def leaf(row, at, right):
            """The values of the leaves of pairs (at, right) of rows."""
            has = np.flatnonzero(right < width)
            values = np.full(len(row), NONE, np.int32)
            base = row[has] * width
            ranks = self._pair_ranks(ids[base + at[has]], ids[base + right[has]])
            known = np.flatnonzero(ranks != NONE)
            has = has[known]
            values[has] = ranks[known] * np.int32(ROW_BYTES) + at[has].astype(np.int32)
            return values

        def update(row, at, value):
            """Set leaves and carry each up to its root."""
            root, node = row * (2 * width), at + width
            flat[root + node] = value
            for _ in range(levels):
                pair = root + (node & -2)
                node = node >> 1
                value = np.minimum(flat[pair], flat[pair + 1])
                flat[root + node] = value

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = flat[row * (2 * width) + 1]
            at, base = (root % ROW_BYTES).astype(np.int64), row * width
            gone = after[base + at].astype(np.int64)
            right = after[base + gone].astype(np.int64)
            ids[base + at] = self.merged[root // ROW_BYTES]
            alive[base + gone] = False
            after[base + at] = right
            has = np.flatnonzero(right < width)
            before[base[has] + right[has]] = at[has]
            update(row, gone, NONE)
            update(row, at, leaf(row, at, right))
            left = before[base + at].astype(np.int64)
            has = np.flatnonzero(left >= 0)
            if len(has):
                update(row[has], left[has], leaf(row[has], left[has], at[has]))
            row = row[flat[row * (2 * width) + 1] < NONE]
        found = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.reshape(n, width).sum(axis=1))).tolist()
        return [found[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_one(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n, size, none = len(piece), self.size, int(NONE)
        width = 1 << (n - 1).bit_length()
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank_of, merged = self.rank_of, self.merged_list

        def leaf(at):
            right = after[at]
            rank = rank_of.get(ids[at] * size + ids[right]) if right >= 0 else None
            return none if rank is None else rank * width + at

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def update(at, value):
            node = at + width
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            right = after[gone]
            ids[at], ids[gone] = merged[rank], -1
            after[at] = right
            if right >= 0:
                before[right] = at
            update(gone, none)
            update(at, leaf(at))
            if before[at] >= 0:
                update(before[at], leaf(before[at]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        found = [b""] * len(pieces)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        low = 0
        for width in (8, 16, 32, ROW_BYTES):
            which = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for start in range(0, len(which), 1 << 14):
                part = which[start : start + (1 << 14)].tolist()
                for k, ids in zip(part, self._merge_rows([raw[k] for k in part], width)):
                    found[k] = ids
        for k in np.flatnonzero(sizes > ROW_BYTES).tolist():
            found[k] = self._merge_one(raw[k])
        return found

    def _learn(self, lead: set[str], plain: set[str]) -> None:
        """Remember the ids of segments (with a space before, or as they are).

        A segment of letters is one piece, and a mark of ``MARKS`` after letters is
        another; the pattern cuts all other segments.
        """
        for segments, known, space in ((lead, self.after_space, " "), (plain, self.plain, "")):
            letters = [s for s in segments if s.isalpha()]
            rest = segments.difference(letters)
            marked = [s for s in rest if s[:-1].isalpha() and s[-1] in MARKS]
            others = rest.difference(marked)
            stems = {s[:-1] for s in marked}.difference(known, letters)
            letters.extend(stems)
            known.update(zip(letters, self._ids_of_pieces([space + s for s in letters])))
            marks = dict(zip(MARKS, self._ids_of_pieces(list(MARKS))))
            for s in marked:
                known[s] = known[s[:-1]] + marks[s[-1]]
            cut = [self.pieces.findall(space + s) for s in others]
            pieces = list({p for c in cut for p in c})
            ids = dict(zip(pieces, self._ids_of_pieces(pieces)))
            for s, c in zip(others, cut):
                known[s] = b"".join(map(ids.__getitem__, c))

    def _wide(self, text: str) -> bool:
        """Whether white space follows a space anywhere."""
        if text.isascii():
            return any(pair in text for pair in WIDE_ASCII)
        return self.wide_space.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A space starts a new piece unless white space follows it, so a text is cut
        at its spaces and each segment is encoded once. A text with white space
        after a space is cut into pieces by the pattern itself.
        """
        for known in (self.after_space, self.plain):
            if len(known) > KEPT:  # those met first are the frequent ones
                for s in list(islice(known, KEPT // 2, None)):
                    del known[s]
        plans, missing = [], (set(), set())
        look = (self.plain.get, self.after_space.get)
        for text in texts:
            plan: list[list[bytes | None]] = []  # ids of segments, in order
            gaps = []  # what is not known yet: (segments, ids, places, with a space before)
            for part in self.special.split(text) if self.special else [text]:
                if part in self.added:
                    plan.append([self.added[part]])
                elif part:
                    if self._wide(part):
                        groups = [(0, self.pieces.findall(part))]
                    else:
                        head, *rest = part.split(" ")
                        groups = [(0, [head] if head else []), (1, rest)]
                    for spaced, segments in groups:
                        found = list(map(look[spaced], segments))
                        plan.append(found)
                        if None in found:
                            places = [k for k, ids in enumerate(found) if ids is None]
                            missing[spaced].update([segments[k] for k in places])
                            gaps.append((segments, found, places, spaced))
            plans.append((plan, gaps))
        self._learn(missing[1], missing[0])
        known = (self.plain, self.after_space)
        result = []
        for plan, gaps in plans:
            for segments, found, places, spaced in gaps:
                ids = known[spaced]
                for k in places:
                    found[k] = ids[segments[k]]
            result.append(b"".join([b"".join(found) for found in plan]))
        for segments, ids in zip(missing, known):
            for s in [s for s in segments if len(s) > KEPT_CHARS]:
                ids.pop(s, None)
        return result

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, tokens)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(spec: bytes, decoder: bool = False) -> ByteBpe:
    return ByteBpe(spec, decoder)


def _spec(docs: DataFrame, path: str):
    """The vocabulary file, read by the driver and broadcast: a few MB whatever the input."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def pieces_of_batch(column: pa.Array, limit: int = 8 << 20) -> Iterator[list[str]]:
    """The texts of a column in turns of about ``limit`` characters; null is empty."""
    turn, held = [], 0
    for value in column:
        text = value.as_py() or ""
        turn.append(text)
        held += len(text)
        if held > limit:
            yield turn
            turn, held = [], 0
    if turn:
        yield turn


def encode(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(id, n_tokens bigint, ids binary) per row: little-endian unsigned 32-bit token ids.

    ``decoded`` adds ``text``: what the ids decode to, in the same pass.

    ``path`` is a tokenizer JSON of the byte-level BPE kind. Strings of added
    tokens in a text become those tokens; no token is added. Null and empty texts
    have no ids. Rows are independent: repeats, ties and null ids are kept as they
    are, an empty table gives no row, and other columns are not read.
    """
    spec = _spec(docs, path)
    id_type = dict(docs.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            done = 0
            for texts in pieces_of_batch(batch.column(1)):
                ids = bpe.encode(texts)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                keys = batch.column(0).slice(done, len(texts))
                done += len(texts)
                columns = [keys, counts, pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_tokens", "ids", "text"][: len(columns)])

    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {id_type}, n_tokens bigint, ids binary" + ", text string" * decoded
    return map_arrow(rows, run, schema).withColumnRenamed("_id", id)


def decode(encoded: DataFrame, path: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, text): the rows of ``encode`` with the text of their ids; null ids give an empty text."""
    spec = _spec(encoded, path)
    id_type = dict(encoded.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value, decoder=True)
        for batch in batches:
            texts = pa.array([bpe.decode(x.as_py() or b"") for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["_id", "n_tokens", "ids", "text"])

    rows = encoded.select(F.col(id).alias("_id"), "n_tokens", F.col(ids).alias("ids"))
    schema = f"_id {id_type}, n_tokens bigint, ids binary, text string"
    return map_arrow(rows, run, schema).withColumnRenamed("_id", id)
