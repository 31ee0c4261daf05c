"""Duplicate lines against brute force on random, repetitive and copied texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditlake.functions.shingles import Windows
from auditlake.operators.duplicates import TOKEN, duplicated_lines, duplicated_lines_by_file, duplicated_ranges


def brute_force(rows, width):
    shingles, by_window = [], defaultdict(Counter)
    for repo, path, content in rows:
        tokens = [
            (t, n) for n, line in enumerate(re.split(r"\r\n|\r|\n", content)) for t in re.findall(TOKEN, line, re.ASCII)
        ]
        for i in range(len(tokens) - width + 1):
            window = tuple(t for t, _ in tokens[i : i + width])
            by_window[repo][window] += 1
            shingles.append((repo, path, window, {n for _, n in tokens[i : i + width]}))
    lines = defaultdict(set)
    for repo, path, window, numbers in shingles:
        if by_window[repo][window] > 1:
            lines[repo, path] |= numbers
    return {key: len(numbers) for key, numbers in lines.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rng.choice([2, 5, 40]))] + ["(", ")", "é"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\n\n", "\r\n"]) for _ in range(n))

    blocks = [text(rng.randint(3, 60)) for _ in range(6)]
    rows = []
    for i in range(25):
        parts = [rng.choice([text(rng.randint(0, 30)), rng.choice(blocks)]) for _ in range(rng.randint(0, 4))]
        rows.append((f"r{i % 3}", f"p{i}", "".join(parts)))
    rows.append(("r0", "periodic", "a b " * 30))
    rows.append(("r1", "constant", "x\n" * 40))
    rows.append(("r2", "twice", text(30) + blocks[0] + "sep\n" + blocks[0]))
    rows.append(("r2", "empty", ""))
    return rows


@pytest.mark.parametrize("seed, width", [(1, 7), (2, 8), (3, 13), (4, 20), (5, 1), (6, 2)])
def test_equals_brute_force(spark, seed, width):
    rows = corpus(seed)
    files = spark.createDataFrame(rows, "repo string, path string, content string").repartition(5)
    got = {(row.repo, row.path): row.duplicated_lines for row in duplicated_lines_by_file(files, width).collect()}
    assert got == brute_force(rows, width)


def test_one_copy_fills_a_third_of_the_corpus(spark):
    licence = "\n".join(f"line {i} of the licence text" for i in range(30))
    rows = [("r", f"c{i}", licence) for i in range(100)] + [("r", f"u{i}", f"{i} " * 80) for i in range(200)]
    rows = [(r, p, t if p.startswith("c") else " ".join(f"{p}x{k}" for k in range(80))) for r, p, t in rows]
    (row,) = duplicated_lines(spark.createDataFrame(rows, "repo string, path string, content string")).collect()
    assert row.duplicated_lines == 100 * 30


@pytest.mark.parametrize("seed, width", [(1, 7), (3, 13)])
def test_ranges_are_the_islands_of_duplicated_lines(spark, seed, width):
    rows = corpus(seed)
    files = spark.createDataFrame(rows, "repo string, path string, content string").repartition(5)
    counted = brute_force(rows, width)
    texts = {(repo, path): [len(re.findall(TOKEN, x, re.ASCII)) for x in re.split(r"\r\n|\r|\n", t)] for repo, path, t in rows}
    got = defaultdict(int)
    ends = {}
    for row in sorted(duplicated_ranges(files, width).collect(), key=lambda r: (r.repo, r.path, r.first_line)):
        sizes = texts[row.repo, row.path]
        held = [n for n in range(row.first_line, row.last_line + 1) if sizes[n - 1]]
        assert len(held) == row.lines and held[0] == row.first_line and held[-1] == row.last_line
        before = ends.get((row.repo, row.path), 0)
        if before:
            assert any(sizes[n - 1] for n in range(before + 1, row.first_line))
        ends[row.repo, row.path] = row.last_line
        got[row.repo, row.path] += row.lines
    assert got == counted


def test_a_half_copied_corpus_writes_runs_not_tokens(spark, tmp_path, monkeypatch):
    rng = random.Random(61)
    rows = []
    for i in range(40):
        body = " ".join(f"w{rng.randrange(10**6)}" + ("\n" if k % 9 == 8 else "") for k in range(3000))
        rows += [("r", f"a{i}", body)] + ([("r", f"b{i}", body)] if i % 2 else [])
    monkeypatch.setattr("auditlake.session.shared_root", lambda _: str(tmp_path))
    ranges = duplicated_ranges(spark.createDataFrame(rows, "repo string, path string, content string")).collect()
    assert len(ranges) == 40 and all(r.first_line == 1 for r in ranges)
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    tokens = sum(len(t.split()) for _, _, t in rows)
    assert 0 < written < 4 * tokens < 0.6 * sum(len(t) for _, _, t in rows), (written, tokens)


def test_only_runs_with_a_repeat_are_compared_window_by_window(spark, tmp_path, monkeypatch):
    rng = random.Random(67)
    phrase = " ".join(f"p{k}" for k in range(40))  # holds a half-window, but no window
    body = [f"w{rng.randrange(10**9)}" for _ in range(6000)]
    text = " ".join([*body[:2000], phrase, *body[2000:4000], phrase, *body[4000:]])
    monkeypatch.setattr("auditlake.session.shared_root", lambda _: str(tmp_path))
    assert duplicated_ranges(spark.createDataFrame([("r", "p", text)], "repo string, path string, content string")).collect() == []
    (windows,) = (tmp_path / "auditlake").glob("windows-*")
    assert spark.read.parquet(str(windows)).count() < 200


def test_tokens_and_lines_are_those_of_the_pattern():
    texts = ["", "é€𝄞x_1\tb\x0bc\r\n\r\n(d)\n\re\ff", "\n\n", "a", "b\r", "\nc d\x00é9é", "  x y z  "]
    held = [text.encode() for text in texts]
    data = np.frombuffer(b"".join(held), np.uint8)
    ends = np.cumsum([0, *map(len, held)])
    found = Windows(data, ends, np.zeros(len(texts), np.uint64), 1)
    expected, words = [], []
    for file, text in enumerate(texts):
        at = 0
        for line, content in enumerate(re.split(r"\r\n|\r|\n", text), 1):
            tokens = re.findall(TOKEN, content, re.ASCII)
            expected += [(file, line, at)] * len(tokens)
            words += tokens
            at += bool(tokens)
    assert list(zip(found.file, found.line, found.at)) == expected
    assert len(set(zip(found.grams, words))) == len(set(found.grams)) == len(set(words))


def test_texts_without_tokens_and_rows_without_repository(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [("r", "a", None), ("r", "b", ""), ("r", "c", " \n"), (None, "d", text), (None, "e", text), ("s", "f", text), ("t", "g", text)]
    schema = "repo string, path string, content string"
    assert duplicated_ranges(spark.createDataFrame(rows, schema)).collect() == []
    assert duplicated_ranges(spark.createDataFrame(rows[:3], schema).coalesce(1)).collect() == []
    (row,) = duplicated_lines(spark.createDataFrame([*rows, ("s", "h", "\n" + text)], schema)).collect()
    assert (row.repo, row.duplicated_lines) == ("s", 2)
    assert [tuple(r) for r in duplicated_ranges(spark.createDataFrame([(7, 1, text), (8, 1, text), (7, 2, text)], "repo bigint, path int, content string")).orderBy("path").collect()] == [(7, 1, 1, 1, 1), (7, 2, 1, 1, 1)]
