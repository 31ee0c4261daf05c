"""Models against brute force, fits that do not depend on how rows lie, long texts, and the pipeline over odd rows."""

import collections
import math
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from auditlake.llm import html_text, langid, lm_score, toxicity
from test_operators import CLASHES, ODD, POOL, RANKS, docs, words

# 7


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in segmentations(word[k:]):
            yield [word[:k], *rest]


def naive_model(texts, train):
    """The formulas of the module's docstring, word by word, over all segmentations."""
    start = lm_score.vocabulary(RANKS)
    logs = dict(zip(start.pieces, start.logs))
    parts = [lm_score.passages_of(t) for t in texts]
    units = collections.Counter(u for p, learn in zip(parts, train) if learn for part in p for u in part)
    passages = collections.Counter(tuple(part) for p, learn in zip(parts, train) if learn for part in p)
    trained = sum(train)

    def discount(counts):
        one, two = (sum(c == n for c in counts.values()) for n in (1, 2))
        return one / (one + 2 * two) if one and two else 0.5

    def paths(word, logs):
        for pieces in segmentations(b" " + word):
            if all(p in logs for p in pieces):
                yield pieces, math.exp(sum(logs[p] for p in pieces))

    uses = collections.Counter()
    for unit in units:
        if unit != lm_score.BREAK:
            found = list(paths(unit, logs))
            whole = sum(p for _, p in found)
            for pieces, p in found:
                for piece in pieces:
                    uses[piece] += p / whole
    n, kinds = sum(units.values()) + trained, len(units) + (trained > 0)
    m, kinds_m = sum(passages.values()) + trained, len(passages) + (trained > 0)
    inner = sum(u for p, u in uses.items() if p[0] != 0x20)
    weights = np.array([uses[p] + 20 * math.exp(logs[p]) + 1e-3 for p in start.pieces])
    model = lm_score.estimated(start.pieces, weights, (kinds + 1) / (kinds + inner + 5))
    logs = dict(zip(model.pieces, model.logs))
    d, d_m = discount(units), discount(passages)
    e = lm_score.END_SHARE

    def lattice(unit):
        if unit == lm_score.BREAK:
            return e
        return (1 - 2 * e) * math.exp(model.end) * sum(p for _, p in paths(unit, logs))

    def word(unit):
        return max(units[unit] - d, 0) / n + d * kinds / n * lattice(unit)

    end = max(trained - d, 0) / n + d * kinds / n * e
    end = max(trained - d_m, 0) / m + d_m * kinds_m / m * end
    for p in parts:
        score = math.log10(end)
        for part in p:
            score += math.log10(max(passages[tuple(part)] - d_m, 0) / m + d_m * kinds_m / m * math.prod(map(word, part)))
        yield score, math.log10(e) + sum(math.log10(lattice(u)) for part in p for u in part)


@pytest.mark.parametrize("frequent", [lm_score.FREQUENT, 3], ids=["held words", "joined words"])
def test_scores_equal_the_formulas(spark, frequent, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    rng = random.Random(71)
    sentences = [words(rng, rng.randint(1, 4), ["the", "cat", "sat", "on", "mat", "dog", "é"]) + "." for _ in range(8)]
    texts = ["\n".join(rng.choices(sentences, k=3)) for _ in range(25)] + ["new wörd here", "", None, "the THE the", "a.b c. d"]
    train = [k % 3 != 0 for k in range(len(texts))]
    table = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(texts, train))], "doc_id bigint, text string, train boolean")
    rows = {r.doc_id: r for r in lm_score.score(table, RANKS, "train").collect()}
    for k, (score, lattice) in enumerate(naive_model(texts, train)):
        assert rows[k].score == pytest.approx(score, rel=1e-9)
        assert rows[k].lattice_score == pytest.approx(lattice, rel=1e-9)


# 3 and 10


def labelled(spark):
    rng = random.Random(72)
    texts = [words(rng, 30, POOL) + (" zorble quimfa" if k % 7 == 0 else "") for k in range(300)] + [None, ""]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(300)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    return table, labels


def test_toxicity_fits_do_not_depend_on_how_rows_lie(spark):
    table, labels = labelled(spark)
    grammars = [
        toxicity.fit(table, labels),
        toxicity.fit(table.repartition(9, "text"), labels.orderBy("toxic")),
        toxicity.fit(table.union(table), labels.union(labels)),
    ]
    assert any(f.startswith(("zorb", "quim")) for f in grammars[0].insults)
    assert all((g.insults, g.worth, g.bias) == (grammars[0].insults, grammars[0].worth, grammars[0].bias) for g in grammars)
    assert toxicity.fit(table, labels, rows=50).insults == toxicity.fit(table.repartition(5), labels.repartition(4), rows=50).insults


def test_language_fits_do_not_depend_on_how_rows_lie(spark):
    rng = random.Random(73)
    rows = [(k, words(rng, 20, POOL if k % 2 else ["le", "chat", "où"]), "en" if k % 2 else "fr") for k in range(200)]
    rows += [(5, "another text of that id", "fr"), (6, None, "en"), (None, "kein", "de"), (7, "x", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = [langid.fit(t) for t in (table, table.repartition(7, "text"), table.union(table).orderBy("text"))]
    for model in models[1:]:
        assert model.langs == models[0].langs and np.array_equal(model.votes, models[0].votes)
        assert (model.temperature, model.threshold) == (models[0].temperature, models[0].threshold)


def test_very_long_texts_take_seconds():
    grammar = toxicity.Grammar({"idiot": 3.0})
    start = time.process_time()
    for text in ("an idiot, " * 300_000, "you idiot. " * 300_000, "x" * 10_000_000, "idiot " + "x " * 3_000_000):
        assert 0 <= grammar.score(text) <= 1
    assert time.process_time() - start < 60


def test_clauses_are_cut_at_the_nearest_marks():
    grammar = toxicity.Grammar({"idiot": 3.0})
    assert list(grammar.clauses("One; an idiot here, idiot there! So idiot\nend idiot")) == [" an idiot here, idiot there", " so idiot", "end idiot"]


# 6


@pytest.mark.parametrize("name", ["b", "header", "div", "p", "a", "span"])
def test_a_hundred_thousand_open_elements_take_seconds(name):
    start = time.process_time()
    html_text.main_text("<body><article>" + f"<{name}>some words " * 100_000)
    assert time.process_time() - start < 30


def test_main_texts_of_literal_pages():
    page = """<html><head><title>t</title><script>x()</script></head><body><nav>Home <a href="/">About</a></nav>
    <div class="sidebar">Buy now</div><article><h1>The title</h1><p>First paragraph, of some length, with commas.</p>
    <p>Second   paragraph &amp; more, long enough to be kept.</p></article><div id="comments"><p>A reader, who comments at some length.</p></div>
    <footer>Imprint</footer></body></html>"""
    assert html_text.main_text(page) == "The title First paragraph, of some length, with commas. Second paragraph & more, long enough to be kept."


# The pipeline


@pytest.mark.parametrize("texts", [ODD, []], ids=["odd rows", "no rows"])
def test_stages_over_odd_rows_and_clashing_columns(spark, sf_dir, texts):
    table = docs(spark, texts)
    table = table.union(table.limit(2)).union(spark.createDataFrame([(None, "no id at all", None, None, None, None, None, None, None)], CLASHES))
    if not texts:
        table = table.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, table, sf_dir)
        assert kept.columns == table.columns, name
        before, after = (collections.Counter(map(tuple, t.collect())) for t in (table, kept))
        assert not after - before, name
        table = kept
    rows = corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).collect()
    assert len(rows) == table.count()


# 2 and 5


def test_large_anchors_are_split_and_lose_no_link(spark, monkeypatch):
    from auditlake.llm import simhash
    from test_operators import classes

    rng = np.random.default_rng(74)
    near = rng.integers(0, 1 << 32, 400, np.uint64) << np.uint64(32)
    flips = np.array([sum(1 << int(b) for b in rng.choice(32, rng.integers(0, 4), replace=False)) for _ in near], np.uint64) << np.uint64(32)
    values = np.unique(np.concatenate([near, near ^ flips, rng.integers(0, 1 << 63, 300, np.uint64)])) | np.uint64(7)
    values = np.unique(values)
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint bigint")
    pairs = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
    keys = values.view(np.int64).tolist()
    want = classes(keys, [(keys[a], keys[b]) for a, b in zip(*pairs) if a < b])
    for sampled, large in ((1, 2), (simhash.SAMPLED, simhash.LARGE)):
        monkeypatch.setattr(simhash, "SAMPLED", sampled)
        monkeypatch.setattr(simhash, "LARGE", large)
        found = [(r.a, r.b) for r in simhash.fingerprint_links(table).collect()]
        assert classes(keys, found) == want


def test_fifty_thousand_fingerprints_of_one_anchor_go_to_many_tasks(spark):
    from auditlake.llm import simhash

    values = np.unique(np.random.default_rng(75).integers(0, 1 << 31, 50_000, np.uint64) << np.uint64(32)).view(np.int64)
    table = spark.createDataFrame([(int(v),) for v in values], "fingerprint bigint")
    start = time.perf_counter()
    assert simhash.fingerprint_links(table).count() < len(values)
    assert time.perf_counter() - start < 120


@pytest.mark.parametrize("chars, passes", [(1, 1), (1, 3), (200, 2)])
def test_benchmarks_of_many_blocks_take_more_passes(spark, monkeypatch, chars, passes):
    from auditlake.llm import decontaminate

    rng = random.Random(76)
    items = [(k, words(rng, rng.randint(1, 30), POOL)) for k in range(12)] + [(None, "only here"), (3, None)]
    texts = [words(rng, 20, POOL) + " " + items[k % 13][1] for k in range(40)]
    table, bench = docs(spark, texts + ODD), spark.createDataFrame(items, "item_id bigint, text string")
    whole = decontaminate.scan(table, bench, keep=["lang"]).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", passes)
    assert sorted(map(repr, decontaminate.scan(table, bench, keep=["lang"]).collect())) == sorted(map(repr, whole))
    assert any(r.n_hit for r in whole)
