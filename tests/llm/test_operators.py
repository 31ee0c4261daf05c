"""Each operator on small tables against brute force, with the rows that real tables hold too."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditlake.llm import (
    bpe,
    components,
    covertree,
    decontaminate,
    html_text,
    langid,
    lm_score,
    packing,
    sharding,
    simhash,
    toxicity,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Columns named like what operators add or use inside.
CLASHES = "doc_id bigint, text string, lang string, score double, size int, fingerprint string, _id int, _text string, n_words int"
ODD = [None, "", " ", "\n\n", "a", "é", "x" * 30_000, "word " * 20_000, "...", "你好 😀", "same text here now", "same text here now"]


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", 0.5, 1, "f", 2, "t", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHES)


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


POOL = ["".join(p) for p in itertools.product("bcdf", "aei", "klm")]


# 1


def test_shards_are_minimax_over_groups(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(1, 60), POOL) for _ in range(300)]
    texts += [texts[0]] * 150 + ODD
    rows = sharding.shard(docs(spark, texts), 5).collect()
    assert len(rows) == len(texts)
    sizes = collections.Counter()
    for row in rows:
        text = texts[row.doc_id]
        assert row.size == len((text or "").encode()) + 1
        assert row.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
        sizes[row.group_key] += row.size
    shard_of = {row.group_key: row.shard for row in rows}
    assert all(shard_of[row.group_key] == row.shard for row in rows)
    for shard in range(5):
        slots = sorted(row.slot for row in rows if row.shard == shard)
        assert slots == list(range(len(slots)))
    ordered = [sizes[k] for k in sorted(sizes)]
    assert [shard_of[k] for k in sorted(sizes)] == sorted(shard_of[k] for k in sizes)

    def feasible(capacity):
        shards, free = 0, 0
        for size in ordered:
            if size > capacity:
                return False
            if size > free:
                shards, free = shards + 1, capacity
            free -= size
        return shards <= 5

    best = next(c for c in range(1, sum(ordered) + 1) if c >= max(ordered) and feasible(c))
    totals = collections.Counter()
    for key, size in sizes.items():
        totals[shard_of[key]] += size
    assert max(totals.values()) == best


def test_cuts_are_exact_when_the_driver_sees_a_coarse_summary(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SUMMARY_ROWS", 8)
    rng = random.Random(2)
    ends = list(itertools.accumulate(rng.randint(1, 50) for _ in range(400)))
    groups = spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "group_key bigint, end bigint")
    cuts = sharding._cuts(groups, ends[-1], 7)
    bounds = [0, *cuts, ends[-1]]
    largest = max(b - a for a, b in zip(bounds, bounds[1:]))
    assert set(cuts) <= set(ends)

    def needed(capacity):
        n, at = 0, 0
        while at < ends[-1]:
            at = max(e for e in ends if e <= at + capacity)
            n += 1
        return n

    assert needed(largest) <= 7 and needed(largest - 1) > 7


# 2


def naive_fingerprint(text, width=3):
    split = (text or "").encode().lower().split()
    if not split:
        return 0
    shingles = [b" ".join(split[i : i + width]) for i in range(max(1, len(split) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [words(rng, 80, POOL) for _ in range(40)]
    texts = list(base)
    for text in base[:20]:
        for _ in range(6):
            split = text.split()
            split[rng.randrange(80)] = rng.choice(POOL)
            texts.append(" ".join(split))
    texts += ODD
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts, 100)).collect()}
    prints = {100 + i: naive_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint % (1 << 64) for i, r in rows.items()} == prints
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in rows.items()} == classes(prints, linked)
    kept = simhash.clean(docs(spark, texts, 100))
    assert {r.doc_id for r in kept.collect()} == set(classes(prints, linked).values())
    assert kept.columns == docs(spark, []).columns


def test_anchors_lose_no_pair(spark):
    rng = random.Random(4)
    points = [rng.getrandbits(64) for _ in range(300)]
    pairs = []
    for point in points:
        for n in range(4):
            other = point
            for bit in rng.sample(range(64), n):
                other ^= 1 << bit
            pairs.append((point, other))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a bigint, b bigint")
    common = F.arrays_overlap(simhash.anchors(F.col("a")), simhash.anchors(F.col("b")))
    assert table.filter(~common).count() == 0
    assert table.select(F.max(F.size(simhash.anchors(F.col("a"))))).first()[0] <= 34


def test_large_anchors_give_a_forest():
    rng = np.random.default_rng(5)
    near = np.unique(np.array([1 << int(a) | 1 << int(b) for a, b in rng.integers(0, 64, (400, 2))], dtype=object).astype(np.uint64))
    far = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    points = np.unique(np.concatenate([near, far]))
    found = list(simhash.links_at_anchors(np.zeros(len(points), np.int64), points, 3))
    linked = [(int(a), int(b)) for x, y in found for a, b in zip(x, y)]
    every = [(int(a), int(b)) for a, b in itertools.combinations(points, 2) if (int(a) ^ int(b)).bit_count() <= 3]
    assert len(linked) < len(points)
    assert classes([int(p) for p in points], linked) == classes([int(p) for p in points], every)


def test_components_of_a_path_a_star_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    random.Random(6).shuffle(links)
    table = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r.node: r.component for r in components.components(table).collect()}
    assert found == classes(set(sum(links, ())), links)
    assert components.components(table.limit(0)).count() == 0


# 3


def language_text(rng, lang, n=40):
    pools = {"xx": ["thalo", "theri", "ando", "winth"], "yy": ["schuk", "gruff", "pfald", "zwenk"], "zz": ["ouéla", "çéri", "mênto"]}
    return " ".join(rng.choice(pools[lang]) + rng.choice(["", "s", "en"]) for _ in range(n))


def test_language_is_learned_and_unknown_is_rejected(spark):
    rng = random.Random(7)
    rows = [(i, language_text(rng, lang), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(table.filter(~langid.held_out()))
    found = langid.identify(table, model, keep=["lang"]).collect()
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 and not r.rejected for r in found)
    odd = langid.identify(docs(spark, ODD), model).collect()
    for row in odd:
        letters = any(c.isalpha() for c in ODD[row.doc_id] or "")
        assert (row.lang_pred == "und") == (not letters) and 0 <= row.score <= 1
        assert row.rejected or letters
    assert next(r for r in odd if r.doc_id == 9).rejected  # a script never seen
    kept = langid.clean(docs(spark, ["thalo theris ando", None, "..."]), model)
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == docs(spark, []).columns


def test_language_without_labels_is_undetermined(spark):
    assert langid.fit(docs(spark, []).limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs(spark, ["abc"]), None).collect()} == {"und"}


# 4


def test_encoding_equals_the_library(spark):
    rng = random.Random(8)
    alphabet = "ab cd  \n\t'sS12é  ​　你好😀.,!?-<|endoftext|>r"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ODD + ["<|endoftext|>", "a<|endoftext|> b", "  x  ", "=-" * 300, "don't we'll  I'm\n \n x", "a" * 500]
    library = Tokenizer.from_file(BPE)
    rows = bpe.decode(bpe.encode(docs(spark, texts), BPE), BPE).collect()
    assert len(rows) == len(texts)
    at_once = {r.doc_id: (r.n_tokens, r.ids, r.text) for r in bpe.encode(docs(spark, texts), BPE, decoded=True).collect()}
    assert at_once == {r.doc_id: (r.n_tokens, r.ids, r.text) for r in rows}
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.n_tokens == len(ids)
        assert row.text == library.decode(ids, skip_special_tokens=False) == (texts[row.doc_id] or "")


def test_row_trees_and_single_trees_agree():
    tokenizer = bpe.ByteBpe(open(BPE, "rb").read())
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b" theinaous.") for _ in range(rng.randint(1, 64))) for _ in range(300)]
    for width in (64,):
        assert tokenizer._merge_rows(pieces, width) == [tokenizer._merge_one(p) for p in pieces]


def test_forgetting_segments_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    tokenizer = bpe.ByteBpe(open(BPE, "rb").read())
    rng = random.Random(10)
    texts = [words(rng, 50, POOL) + "." for _ in range(30)]
    turns = [tokenizer.encode([t])[0] for t in texts]
    assert turns == bpe.ByteBpe(open(BPE, "rb").read()).encode(texts)


# 5


def naive_windows(texts, items, width):
    split = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    import re

    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", split(t))
    result = {}
    for key, text in enumerate(texts):
        doc, hit, owners = tokens(text), set(), set()
        for name, item in items:
            w = tokens(item)
            n = min(width, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(doc) - n + 1):
                if n and tuple(doc[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    owners.add(str(name))
        result[key] = (len(doc), len(hit), sorted(owners))
    return result


@pytest.mark.parametrize("block", [1, 1 << 23])
def test_windows_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)  # one automaton an item, or one for all
    rng = random.Random(11)
    pool = ["Ab", "c", "d9", "é", "ÉA"]
    items = [(i, words(rng, rng.choice([0, 2, 5, 9, 20]), pool)) for i in range(20)] + [(20, None), (3, "ab c d9"), (21, "...")]
    texts = [words(rng, rng.randint(0, 60), pool).replace(" ", rng.choice([" ", ", ", "\n"])) for _ in range(80)] + ODD
    texts += [text for _, text in items]
    table = spark.createDataFrame(items, "item_id int, text string")
    rows = decontaminate.scan(docs(spark, texts), table, width=5, keep=["n_words"]).toDF("doc_id", "kept", *decontaminate.RESULT.names).collect()
    want = naive_windows(texts, [(i, t) for i, t in items if t is not None], 5)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == want
    for row in rows:
        raw = (texts[row.doc_id] or "").encode()
        spanned = b" ".join(raw[a:b] for a, b in row.spans).translate(decontaminate._FOLD).split()
        assert len(spanned) == row.n_hit


def test_contaminated_documents_go(spark):
    table = spark.createDataFrame([(1, "one two three four")], "item_id int, text string")
    texts = ["so one two three four", "x " * 77 + "one two three four", "clean", None, "one two three"]
    kept = decontaminate.clean(docs(spark, texts), table)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4] and kept.columns == docs(spark, []).columns
    assert decontaminate.clean(docs(spark, texts), table.limit(0)).count() == 5


@pytest.mark.parametrize("block", [1, 1 << 23])
def test_items_without_id_hit_but_are_not_named(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    table = spark.createDataFrame([(None, "one two three four"), (1, "five six"), (None, "five six"), (None, None)], "item_id int, text string")
    texts = ["so one two three four", "one two five six", "clean", "one two three"]
    rows = decontaminate.scan(docs(spark, texts), table).orderBy("doc_id").collect()
    assert [(r.n_hit, r["items"]) for r in rows] == [(4, []), (2, ["1"]), (0, []), (0, [])]
    kept = decontaminate.clean(docs(spark, texts), table)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


# 6


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b, c", "a b, c"),
        ("<body>Just text &amp; more &#x41;</body>", "Just text & more A"),
        ("<nav>menu</nav><footer>f</footer>", ""),
        ("<div id=sidebar><p>" + "x, " * 50 + "</p></div><div class=content><p>" + "real text, " * 20 + "</p><p>short</p><ul><li>one<li>two</ul>"
         "</div><div class=comments><p>" + "bad comment, " * 40 + "</p></div>", ("real text, " * 20).strip() + " short one two"),
        ("<header><h1>Site</h1></header><main><h1>T</h1><p>One, two and more words here.</p><form>f<input></form><p>End.</main><aside>s</aside>",
         "T One, two and more words here. End."),
        ("<article><h1>A  b</h1><p><b>A<br>c\n d<script>var t='</p>'</script><style>p{}</style><!-- n --></p></article><footer>no</footer>", "A b A c d"),
        ("<article><p>" + "w " * 30 + "</p><figure><figcaption>cap</figcaption></figure></article>", ("w " * 30) + "cap"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LONG = ("many words, and more " * 20).strip()
LINKS = "<div><a href=x>one link</a> <a href=y>another link</a></div>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><div class=page-content><section><p>{LONG}</p></section><section><h4>Note</h4><p>Short.</p></section></div></body>", f"{LONG} Note Short."),
        (f"<body><div><section><p>First.</p></section>{LINKS}<section><p>{LONG}</p></section><div class=share>s</div></div></body>", f"First. {LONG}"),
        (f"<body><div>In <b>line</b>, <a href=x>l</a>!<br>More<section><p>{LONG}</p></section></div></body>", f"In line, l! More {LONG}"),
        (f"<body><div class=content><div><section><p>{LONG}</p></section></div><div><section>Short.</section></div></div><div>Own site</div></body>", f"{LONG} Short."),
        (f"<body><div>Own site</div><div><p>{LONG}</p></div><div>Short.</div><div><p>{LONG}</p></div><div>All rights</div></body>", f"{LONG} Short. {LONG}"),
        (f'<body><article><header class="entry-header"><h1>Title</h1></header><p>{LONG}</p></article></body>', f"Title {LONG}"),
        (f'<body><header class="header"><h1>Site</h1></header><article><header class="header">Title</header><p>{LONG}</p></article></body>', f"Title {LONG}"),
    ],
)
def test_main_text_keeps_short_sections_and_titles(page, text):
    assert html_text.main_text(page) == text


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None), (2, "v", "<" * 5000), (3, "w", "<div>" * 3000 + "deep")]
    table = spark.createDataFrame(rows, "page_id bigint, text string, html string")
    found = html_text.extract(table, keep=["text"])
    assert [row[-1] for row in found.orderBy("page_id").collect()] == ["", "x", "x", "<" * 5000, "deep"]
    assert html_text.extract(table.limit(0)).count() == 0


# 7


def naive_lattice(word, model):
    """Sum over all segmentations, by recursion."""
    score = {p: math.exp(s) for p, s in zip(model.pieces, model.logs)}

    def total(rest, first):
        if not rest:
            return math.exp(model.end)
        return sum(score[rest[:k]] * total(rest[k:], False) for k in range(1, len(rest) + 1) if rest[:k] in score)

    return math.log(total(b" " + word, True))


def test_lattice_sums_all_segmentations():
    model = lm_score.vocabulary(RANKS)
    pool = [b"a", b"the", b"hello", b"xqz", "é".encode(), b"tionings"]
    got = model.log_likelihoods(pool)
    assert np.allclose(got, [naive_lattice(w, model) for w in pool])
    long = b"thing" * 30  # has a recursion of its own
    assert math.isfinite(model.log_likelihoods([long])[0])
    first = np.array([p[0] == 0x20 for p in model.pieces])
    assert math.isclose(np.exp(model.logs[first]).sum(), 1) and math.isclose(np.exp(model.logs[~first]).sum() + math.exp(model.end), 1)


@pytest.mark.parametrize("frequent", [3, 200_000])
def test_scores_equal_one_computed_from_the_counts(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    rng = random.Random(12)
    texts = [". ".join(words(rng, rng.randint(1, 12), POOL[:12] + ["end"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts += texts[:10] + ODD
    table = docs(spark, texts).withColumn("train", F.col("doc_id") % 5 != 0)
    rows = {r.doc_id: r for r in lm_score.score(table, RANKS, "train").collect()}
    train = [t for i, t in enumerate(texts) if i % 5]
    counts = collections.Counter(w for t in train for w in lm_score.words_of(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for i, text in enumerate(texts):
        tokens = lm_score.words_of(text)
        c = [counts[w] for w in tokens] + [len(train)]
        assert math.isclose(rows[i].base_score, sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), rel_tol=1e-9)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(c), sum(x > 0 for x in c), n)
        assert rows[i].score < 0 and math.isfinite(rows[i].score)
    if frequent == 3:
        test_scores_equal_one_computed_from_the_counts.scores = {i: r.score for i, r in rows.items()}
    else:  # which way a word goes changes nothing
        other = test_scores_equal_one_computed_from_the_counts.scores
        assert all(math.isclose(other[i], r.score, rel_tol=1e-9) for i, r in rows.items())


def test_lattice_has_the_longest_pieces():
    model = lm_score.vocabulary(RANKS)
    assert b" responsibilities" in model.pieces and model.longest > 16
    pool = [b"responsibilities", b"-" * 18]
    assert np.allclose(model.log_likelihoods(pool), [naive_lattice(w, model) for w in pool])
    long = next(p for p in model.pieces if len(p) == model.longest)
    score = model.logs[model.pieces.index(long)]
    assert model.log_likelihoods([b"a" + long])[0] >= model.logs[model.pieces.index(b" a")] + score + model.end


def test_passages_end_at_every_sentence_and_line():
    units = lambda text: [b" ".join(p).decode() for p in lm_score.passages_of(text)]
    assert units("To a. Or b! (Is it c?) A\u0416.\r\nrow one 3.14 a.b\n\n | x | y") == ["to a.", "or b!", "(is it c?)", "a\u0416.", "row one 3.14 a.b \n", "| x | y \n"]
    assert units("甲乙。丙丁！「戊。」 己") == ["甲乙。\v", "丙丁！\v", "「戊。」", "己 \n"]
    assert units("क ख। ग؟ ") == ["क ख।", "ग؟"] and units(None) == units(" \n") == []
    assert len(units("." * 100_000 + "x")) == 1


@pytest.mark.parametrize("frequent", [3, 200_000])
def test_recurring_passages_score_better_in_any_script(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    rng = random.Random(21)
    kana = [chr(c) for c in range(0x3042, 0x3090)]
    letters = [chr(c) for c in range(0x430, 0x450)]
    of = lambda pool, blank: blank.join("".join(rng.choice(pool) for _ in range(6)) for _ in range(8))
    for end, pool, blank in [("! ", "klmnop", " "), ("\n", "klmnop", " "), (". ", letters, " "), ("。", kana, "")]:
        fresh = lambda: of(pool, blank)
        passage, other = fresh(), fresh()
        texts = [fresh() + end + passage + end + fresh() + end + other[: len(other) // 2] + fresh() + end for _ in range(20)]
        texts += [fresh() + end + passage + end + fresh(), fresh() + end + fresh() + end + fresh()]
        table = docs(spark, texts).withColumn("train", F.col("doc_id") < 20)
        rows = {r.doc_id: r for r in lm_score.score(table, RANKS, "train").collect()}
        assert all(r.n_tokens == len(lm_score.words_of(texts[i])) + 1 for i, r in rows.items())
        assert rows[20].score > rows[21].score + 20, end


def test_without_training_the_lattice_scores(spark):
    table = docs(spark, ["a b", None]).withColumn("train", F.lit(False))
    rows = lm_score.score(table, RANKS, "train").collect()
    assert len(rows) == 2 and all(r.score < 0 and r.train_tokens == 0 for r in rows)
    assert lm_score.score(table.limit(0), RANKS, "train").count() == 0


# 8


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "DIRECT", 50)
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(12, 16))
    near = centres[rng.integers(0, 12, 200)] + rng.normal(size=(200, 16)) * rng.choice([0.01, 0.1, 0.25], (200, 1))
    dense = centres[0] + rng.normal(size=(150, 16)) * 0.02
    vectors = np.concatenate([near, dense, rng.normal(size=(60, 16)), near[:5], near[:5] * 3])
    rows = [(i, x.tolist(), None) for i, x in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, x, None) for i, x in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component_id int")
    found = {r.vec_id: r for r in covertree.near_vectors(table, 0.95).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    pairs = [(a, b) for a, b in zip(*map(lambda x: x.tolist(), np.nonzero(linked))) if a < b] + [(1006, 1007)]
    want = classes(found, pairs)
    n = collections.Counter(sum(pairs, ()))
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {i: (n[i], want[i], want[i] == i) for i in found}
    assert covertree.near_vectors(table.limit(0)).count() == 0


def test_nets_cover_and_keep_apart():
    rng = np.random.default_rng(14)
    points = covertree.units(rng.normal(size=(700, 4)))
    groups = list(covertree.net(points, 0.5))
    assert sorted(np.concatenate(groups).tolist()) == list(range(700))
    centres = points[[g[0] for g in groups]]
    assert all(np.linalg.norm(points[g] - points[g[0]], axis=1).max() <= 0.5 + 1e-9 for g in groups)
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) + 9 * np.eye(len(centres))
    assert apart.min() > 0.5


# 9


def test_packing_is_lossless_and_best_fit(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 3000)
    rng = random.Random(15)
    texts = [words(rng, rng.randint(0, 90), POOL) for _ in range(120)] + ODD
    library = Tokenizer.from_file(BPE)
    rows = packing.pack_texts(docs(spark, texts), BPE, eos=50256, length=64, pad=9).collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    parts = collections.defaultdict(dict)
    for row in rows:
        ids, positions = np.frombuffer(row.input_ids, "<u2"), np.frombuffer(row.position_ids, "<u2")
        ends = row.cu_seqlens
        assert len(ids) == 64 and ends[0] == 0 and ends[-1] == row.n_tokens <= 64 and (ids[row.n_tokens :] == 9).all()
        for doc, start, a, b in zip(row.doc_ids, row.doc_starts, ends, ends[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts[doc][start] = ids[a:b].tolist()
    for i, text in enumerate(texts):
        whole = sum((parts[i][s] for s in sorted(parts[i])), [])
        assert whole == library.encode(text or "", add_special_tokens=False).ids + [50256]
    ids = bpe.encode(docs(spark, texts), BPE)
    again = packing.pack_ids(ids, length=64)
    assert again.agg(F.sum("n_tokens")).first()[0] == ids.agg(F.sum("n_tokens")).first()[0]
    assert packing.pack_texts(docs(spark, []), BPE, eos=1).count() == 0


def test_room_finds_the_fullest_row():
    rng = random.Random(16)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    rows = packing.best_fit_decreasing(sizes, 50)
    free: list[int] = []
    for size in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= size]
        if fits:
            free[free.index(min(fits))] -= size
        else:
            free.append(50 - size)
    assert sorted(50 - sum(sizes[k] for k in row) for row in rows) == sorted(free)
    assert sorted(k for row in rows for k in row) == list(range(300))


# 10


def test_grammar_marks_negation_speech_and_targets():
    grammar = toxicity.Grammar({"idiot": 3.0, "vequ*1": 2.0})
    kinds = lambda text: [k for k, *_ in grammar.matches(text)]
    assert kinds("You are an Idiot.") == ["It"]
    assert kinds("Idiot!") == ["I"]
    assert kinds("He is not an idiot") == ["I-t"]
    assert kinds('It said "idiot" once. Idiot') == ["Ir", "I"]
    assert kinds("an idiotic thing") == [] and kinds("le vequaire") == ["I"]
    assert kinds("I will kill you") == ["Ht"] and kinds("kill the process") == ["H"]
    assert grammar.score("You idiot") > grammar.score("not an idiot") > grammar.score("nothing here")
    assert 0 <= grammar.score(None) == grammar.score("") <= 1


def test_composition_equals_the_transducers_in_turn():
    rng = random.Random(17)
    for _ in range(200):
        symbols = [rng.choice("IHTNRQO") for _ in range(rng.randint(0, 15))]
        out = symbols
        for step in (toxicity.negation, toxicity.reported, toxicity.target):
            state, marked = 0, []
            for symbol in out:
                state, symbol = step(state, symbol)
                marked.append(symbol)
            out = marked
        assert toxicity.FORWARD.run(symbols) == out


def test_toxic_words_and_stems_are_learned(spark):
    rng = random.Random(18)
    texts, toxic = [], []
    for i in range(400):
        bad = i % 8 == 0
        extra = [rng.choice(["zorble", "quimfa" + rng.choice("abcdef"), "quimfo" + rng.choice("abcdef")])] if bad else []
        split = [rng.choice(POOL) for _ in range(30)] + extra
        rng.shuffle(split)
        texts.append(" ".join(split))
        toxic.append(int(bad))
    table = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    grammar = toxicity.fit(table, labels.filter(~toxicity.held_out()))
    rows = {r.doc_id: r.score for r in toxicity.score(table, grammar).collect()}
    assert [int(rows[i] >= toxicity.PREDICTED) for i in range(400)] == toxic
    assert len(rows) == len(texts) + len(ODD)
    kept = toxicity.clean(table, grammar)
    assert kept.count() == len(rows) - sum(toxic) and kept.columns == table.columns
    untaught = toxicity.fit(table, labels.limit(0))
    assert untaught.score("you idiot") > untaught.score("hello")
    assert toxicity.score(docs(spark, []), grammar).count() == 0


