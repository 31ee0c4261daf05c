"""Exact dedup by recipes, spelling variants and the conversation trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import prefix_trie, recipes, spelling
from test_operators import ODD, POOL, docs, words

# 11


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def naive_groups(rows):
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[fold(text)].append(key)
    found = []
    for key, text in rows:
        ids = [k for k in groups[fold(text)] if k is not None]
        keep = max(ids, default=None)
        found.append((key, keep, len(groups[fold(text)]), key == keep, hashlib.sha256(fold(text).encode()).hexdigest()))
    return collections.Counter(found)


def odd_texts():
    rng = random.Random(31)
    texts = [words(rng, rng.randint(1, 900), POOL) for _ in range(120)]
    texts += [t.upper() for t in texts[:20]] + [t + " " for t in texts[:5]] + ["x" + t for t in texts[:5]]
    return texts + [texts[0]] * 60 + ODD + ["É", "é", "日本 " * 3000, "日本 " * 3000, "A\n" * 4000, "a\n" * 4000]


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(7))], ids=["whole hash", "clashing hashes"])
def test_groups_of_equal_texts(spark, hashed):
    rows = list(enumerate(odd_texts()))
    found = recipes.duplicates(docs(spark, [t for _, t in rows]), hashed=hashed)
    assert collections.Counter(map(tuple, found.collect())) == naive_groups(rows)


def test_null_ids_and_repeated_rows_of_recipes(spark):
    rows = [(None, "a"), (None, "A"), (3, "a"), (3, "a"), (None, "alone"), (4, None), (5, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert collections.Counter(map(tuple, recipes.duplicates(table).collect())) == naive_groups(rows)
    assert recipes.duplicates(table.limit(0)).count() == 0


def test_chunks_are_the_text_and_follow_its_words(spark):
    texts = [t or "" for t in odd_texts()]
    rows = docs(spark, texts).select("text", recipes.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text and all(r.c) for r in rows)
    rng = random.Random(32)
    body = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(3000))
    first, second = (r.c for r in docs(spark, [body, "other words before " + body]).select(recipes.chunks(F.col("text")).alias("c")).collect())
    assert len(first) > 5 and first[1:] == second[-len(first) + 1 :]


def test_recipes_run_no_python(spark):
    plan = recipes.duplicates(docs(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# 12


def naive_variants(rows, least=7):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = fold(run)
            number = zlib.crc32(f"{key}:{word}".encode())
            if number % 31 == 0:
                word = word[: number % len(word)] + word[number % len(word) + 1 :]
            counts[word] += 1
    known = {w: n for w, n in counts.items() if n >= 2 and len(w) >= least}

    def close(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in known if close(w, x)] for w in known}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= 10 * known[w] else None
    rows = set()
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), known[form[w]] if form[w] else None))
    return rows


def spelled():
    rng = random.Random(33)
    base = ["".join(rng.choice(["tion", "ment", "é", "×", "ra", "lo", "bi"]) for _ in range(4)) for _ in range(60)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabaaaa"]
    texts = []
    for _ in range(150):
        said = [rng.choice(base[: rng.randint(1, len(base))]) for _ in range(40)]
        for k in range(len(said)):
            if rng.random() < 0.15:
                at = rng.randrange(len(said[k]))
                said[k] = said[k][:at] + rng.choice(["", "z", "Z", "éa"]) + said[k][at + rng.randint(0, 1) :]
        texts.append(" ".join(said))
    # A chain of forms, each one edit from the last.
    texts += [" ".join(["chainword"] * 300 + ["chainwore"] * 15 + ["chainhore"] * (k % 2)) for k in range(12)]
    return texts + ODD + ["y" * 20_000, "y" * 20_000, "y" * 19_999, "y" * 19_999]


@pytest.mark.parametrize("cells", [spelling.CELLS, 64], ids=["whole blocks", "cut blocks"])
def test_variants_equal_brute_force(spark, cells, monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", cells)
    texts = spelled()
    found = [tuple(r) for r in spelling.variants(docs(spark, texts)).collect()]
    want = naive_variants(list(enumerate(texts)))
    assert set(found) == want and len(found) == len(want)
    assert any(form and root != form for _, form, root, *_ in want)


def test_odd_tables_of_words(spark):
    table = spark.createDataFrame([(None, "variant variants"), (None, "Variant variants"), (1, None)], "doc_id bigint, text string")
    assert {r.word for r in spelling.variants(table).collect()} == {w for w, *_ in naive_variants([(None, "variant variants")] * 2)}
    assert spelling.variants(table.limit(0)).count() == 0


def test_gram_products_lose_no_pair():
    rng = np.random.default_rng(34)
    codes = rng.integers(97, 100, (300, 8), np.uint8)
    letters = spelling._letter_counts(codes)
    norms = np.einsum("ij,ij->i", letters, letters)
    every = np.arange(len(codes))
    found = {(a, b) for x, y in spelling.near(letters, norms, every, every, True) for a, b in zip(x.tolist(), y.tolist())}
    near = ((letters[:, None] - letters[None]) ** 2).sum(axis=2) <= 2
    assert found == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near))) if a < b}


# 13


def naive_trie(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = collections.Counter(), collections.Counter()
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    found = set()
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(paths[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        found.add((min(of), len(node), parent, len(of), len(children[node]), leaves[node], saved[node], digest))
    return found


SAID = "conv_id bigint, turn bigint, role string, text string, key string, path string, depth int"


def said():
    rng = random.Random(35)
    rows = []
    for c in [*range(40), *range(100, 160), 205, 206, 207, 1000, 10_000_000_007]:
        for t in range(rng.choice([1, 2, 3, 6, 7, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "a", "a", None, "", "😀 é"])))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 380) for t in range(300 if c in (300, 301) else 4)]
    rows += [(400, None, "user", "first"), (400, 3, "user", "x" * 40_000), (None, 1, "user", "nobody")]
    return rows


@pytest.mark.parametrize("turns", [prefix_trie.RUN_TURNS, 20, 1], ids=["long runs", "short runs", "single paths"])
def test_trie_equals_brute_force(spark, turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "SEGMENT_IDS", 3)
    rows = said()
    table = spark.createDataFrame([(*r, "k", "p", 1) for r in rows], SAID)
    found = [tuple(r) for r in prefix_trie.trie(table).drop("key").collect()]
    want = naive_trie(rows)
    assert set(found) == want and len(found) == len(want)
    assert any(d == 0 for _, d, *_ in found) and max(d for _, d, *_ in found) >= 300


def test_empty_and_turnless_conversations(spark):
    table = spark.createDataFrame([(1, 0, "user", "x", "", "", 0)], SAID)
    assert {tuple(r) for r in prefix_trie.trie(table).drop("key").collect()} == naive_trie([(1, 0, "user", "x")])
    assert prefix_trie.trie(table.limit(0)).count() == 0


def test_repeated_rows_are_turns(spark):
    rows = [(7, 1, "user", "x")] * 9 + [(8, 1, "user", "x")] * 9
    table = spark.createDataFrame([(*r, "", "", 0) for r in rows], SAID)
    assert {tuple(r) for r in prefix_trie.trie(table).drop("key").collect()} == naive_trie(rows)
