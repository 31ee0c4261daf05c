"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns the words of a clause into symbols: insult, threat, target,
negation, reported speech, quotation mark, other. Small transducers pass the
symbols on and mark insults and threats that are negated, reported or directed at
someone; composed, they read a clause once. A matched clause weighs as much as
its words' log odds times what its marks are worth. Lexicon weights and the worth
of the marks are learned from labels; only clauses that hold an insult or a
threat are read by the grammar at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from auditlake.llm.workers import keep_rows, map_arrow, with_text
from auditlake.session import written

LABELLED_ROWS = 20_000  # labelled rows the model is fitted on, at most
PARTS = 64  # tasks that the labelled texts are dealt over
FLUSH = 200_000  # counts a task holds before it passes them on
STEMS = range(4, 9)  # letters of a stem
LEVELS = (1, 2, 3, 5)  # a form ``stem*n``: at least n different words of the text begin so
LEAST = 4  # labelled texts that must hold a candidate
PURITY = 0.75  # least share of toxic ones among them
FALSE_COST = 2  # clean texts weigh so much more than toxic ones when a candidate is chosen
LEAST_GAIN = 3
PRIOR_WEIGHT = 3.0  # of words the labels say nothing about
PREDICTED = 0.3

# Own general vocabulary: what the grammar knows before it has seen a label.
INSULTS = "idiot idiota idioten moron stupid imbecile imbécile scum loser worthless pathetic dummkopf trottel abschaum connard crétin ordure estúpido imbécil basura".split()
THREATS = "kill hurt destroy murder beat strangle töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours u he she they them him her du dich dir ihr euch sie er tu te toi vous il elle ils elles tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not no never none neither cannot don't isn't aren't won't didn't nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás".split()
REPORTS = "said says say called calls wrote writes quoted reported claimed told sagte sagt nannte schrieb zitierte dit disait écrit appelé cité dijo dice llamó escribió citó".split()

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”„«»]")
BREAK = re.compile(r"[.!?;|\n]")
NEGATION_SCOPE = 3

Step = Callable[[int, str], tuple[int, str]]


def _is_match(symbol: str) -> bool:
    return symbol[0] in "IH"


def negation(state: int, symbol: str) -> tuple[int, str]:
    """Marks matches within a few words of a negation with ``-``."""
    if symbol == "N":
        return NEGATION_SCOPE, symbol
    return max(0, state - 1), symbol + "-" if state and _is_match(symbol) else symbol


def reported(state: int, symbol: str) -> tuple[int, str]:
    """Marks matches after a verb of speech (bit 1) or between quotation marks (bit 2) with ``r``."""
    if symbol == "R":
        return state | 1, symbol
    if symbol == "Q":
        return state ^ 2, symbol
    return state, symbol + "r" if state and _is_match(symbol) else symbol


def target(state: int, symbol: str) -> tuple[int, str]:
    """Marks matches after a target with ``t``."""
    if symbol == "T":
        return 1, symbol
    return state, symbol + "t" if state and _is_match(symbol) else symbol


class Composed:
    """The composition of transducers; transitions are built as they are met."""

    def __init__(self, *steps: Step):
        self.steps = steps
        self.start = (0,) * len(steps)
        self.table: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]] = {}

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str]:
        key = (state, symbol)
        if key not in self.table:
            after = []
            for transducer, part in zip(self.steps, state):
                part, symbol = transducer(part, symbol)
                after.append(part)
            self.table[key] = (tuple(after), symbol)
        return self.table[key]

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, mark = self.step(state, symbol)
            out.append(mark)
        return out


FORWARD = Composed(negation, reported, target)
BACKWARD = Composed(target)  # a target that follows
KINDS = [b + n + r + t for b in "IH" for n in ("", "-") for r in ("", "r") for t in ("", "t")]


@dataclass
class Grammar:
    """Words and forms ``stem*n`` with their weights, and what a match of each kind is worth."""

    insults: dict[str, float]
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, PRIOR_WEIGHT))
    worth: dict[str, float] = field(default_factory=lambda: dict(zip(KINDS, _prior_worth())))
    bias: float = -3.0

    def __post_init__(self):
        self.levels: dict[str, tuple[str, dict[int, float]]] = {}  # of a word, or a stem with its ``*``
        for symbol, lexicon in (("H", self.threats), ("I", self.insults)):
            for form, weight in lexicon.items():
                stem, star, n = form.partition("*")
                levels = self.levels.get(stem + star)
                if levels is None or levels[0] != symbol:
                    levels = self.levels[stem + star] = (symbol, {})
                levels[1][int(n or 1)] = weight
        self.automaton = ahocorasick.Automaton()
        for entry in self.levels:
            self.automaton.add_word(entry.rstrip("*"), len(entry.rstrip("*")))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.other = {w: s for s, group in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in group}

    def entry(self, word: str) -> tuple[str, str] | None:
        """The symbol and the heaviest lexicon entry of a word; a whole word goes before stems."""
        if word in self.levels:
            return self.levels[word][0], word
        found = [e for e in (word[:n] + "*" for n in STEMS if n <= len(word)) if e in self.levels]
        if not found:
            return None
        best = max(found, key=lambda e: (max(self.levels[e][1].values()), len(e)))
        return self.levels[best][0], best

    def clauses(self, text: str) -> Iterator[str]:
        """The lower-cased clauses that hold an entry at the start of a word."""
        low, done = text.lower(), 0
        if not len(self.automaton):
            return
        for last, length in self.automaton.iter(low):
            first = last + 1 - length
            if first < done or (first and low[first - 1].isalpha()):
                continue
            start = max(done, max(low.rfind(c, done, first) for c in ".!?;|\n") + 1)
            end = BREAK.search(low, first)
            done = end.start() if end else len(low)
            yield low[start:done]

    def matches(self, text: str) -> list[tuple[str, str, str]]:
        """(kind, entry, word) of every insult and threat of a text."""
        found = []
        for clause in self.clauses(text):
            tokens = TOKEN.findall(clause)
            entries = [self.entry(t) for t in tokens]
            symbols = [e[0] if e else self.other.get(t) or ("Q" if not t[0].isalpha() else "O") for e, t in zip(entries, tokens)]
            marks = FORWARD.run(symbols)
            later = BACKWARD.run(symbols[::-1])[::-1]
            for e, mark, after, word in zip(entries, marks, later, tokens):
                if e:
                    found.append((mark + "t" if after[-1] == "t" and mark[-1] != "t" else mark, e[1], word))
        return found

    def evidence(self, matches: list[tuple[str, str, str]]) -> np.ndarray:
        """Sum of weights by kind. A word that repeats adds less each time; a stem weighs what its level does."""
        total, seen = np.zeros(len(KINDS)), Counter()
        words: dict[str, set[str]] = {}
        for kind, entry, word in matches:
            levels = self.levels[entry][1]
            if entry[-1] != "*":
                seen[entry] += 1
                add = levels[1] / seen[entry]
            else:
                known = words.setdefault(entry, set())
                if word in known:
                    continue
                known.add(word)
                reached = max((w for n, w in levels.items() if n <= len(known)), default=0.0)
                add = max(0.0, reached - seen[entry])
                seen[entry] += add
            total[KINDS.index(kind)] += add
        return np.minimum(total, 30.0)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.evidence(self.matches(text or "")) @ np.array([self.worth[k] for k in KINDS]))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _prior_worth() -> np.ndarray:
    """Before labels: half for a negated or reported match, a threat counts only when directed, more for a directed one."""
    return np.array([(0.5 if "-" in k else 1) * (0.5 if "r" in k else 1) * (1.2 if "t" in k else 1.0 if k[0] == "I" else 0.2) for k in KINDS])


def _copies_key(text: str) -> int:
    """Equal for most near copies: the smallest hash of the word triples."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    triples = zip(words, words[1:], words[2:]) if len(words) > 2 else [tuple(words)]
    return min(xxh64_intdigest(b" ".join(t), 11) for t in triples) - (1 << 63)


def _forms(text: str) -> set[str]:
    """The words of a text and the levels that its stems reach."""
    words = set(WORD.findall(text.lower()))
    stems = Counter(w[:n] for w in words for n in STEMS if n <= len(w))
    return words | {f"{stem}*{n}" for stem, count in stems.items() for n in LEVELS if n <= count}


def choose(texts: list[tuple[int, list[str]]]) -> list[str]:
    """A small lexicon: candidates that explain most toxic texts not yet explained, fewest clean ones.

    ``texts``: (label, candidates it holds). Words that merely go with an insult
    explain nothing new once it is chosen.
    """
    holders: dict[str, list[int]] = {}
    for k, (_, forms) in enumerate(texts):
        for form in forms:
            holders.setdefault(form, []).append(k)
    label = np.array([y for y, _ in texts], bool)
    value = np.where(label, 1, -FALSE_COST)
    index = {form: np.array(k) for form, k in holders.items()}
    bound = {form: float((label[k]).sum() - FALSE_COST * (~label[k]).sum()) for form, k in index.items()}
    free, chosen = np.ones(len(texts), bool), []
    heap = sorted(bound, key=lambda f: (-bound[f], -len(f), f))
    while heap:
        best, best_gain = None, LEAST_GAIN - 1
        for form in heap:
            if bound[form] <= best_gain:
                break  # gains of toxic texts only shrink
            k = index[form]
            gain = float((value[k] * (free[k] | ~label[k])).sum())
            bound[form] = gain
            if gain > best_gain:
                best, best_gain = form, gain
        if best is None:
            break
        chosen.append(best)
        free[index[best]] = False
        heap = sorted((f for f in heap if f != best and bound[f] >= LEAST_GAIN), key=lambda f: (-bound[f], -len(f), f))
    return chosen


def _descend(x: np.ndarray, y: np.ndarray, prior: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic regression with weights drawn to their priors; Newton steps."""
    design = np.c_[x, np.ones(len(x))]
    start = np.r_[prior, bias]
    pull = np.r_[np.full(x.shape[1], 2.0), 0.01]
    w = start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + pull * (w - start)
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(pull)
        w -= np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return np.maximum(w[:-1], 0.0), float(w[-1])


def held_out(id: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row is kept from learning: by crc32 of its id as text; rows without id are."""
    number = F.crc32(F.col(id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(number, F.lit(modulus)) == remainder, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", rows: int = LABELLED_ROWS) -> Grammar:
    """A grammar learned from at most ``rows`` labelled rows, those of the smallest id hashes.

    Labels and texts without id or value, and null texts, teach nothing. A label
    that repeats counts as its largest value; of the texts of a repeated id the one
    of the smallest hash counts, ties to the smaller text. Of near copies in the
    sample one is kept, by the same order. So equal tables give equal grammars,
    however their rows lie. Without labels the grammar keeps its general vocabulary.

    The sampled ids are a bounded table, so texts are not shuffled to find them.
    Forms are counted over all sampled texts on Spark; the driver gets the forms
    that are pure enough, all of them, and each sampled text's share of these.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(label).alias("_y"))
    sample = known.orderBy(F.xxhash64(F.col("_id"), F.lit("sample")), "_id").limit(rows)
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    found = texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(
        F.max("_y").cast("int").alias("y"), F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("s")
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([_copies_key(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["h", "y", "t", "k"])

    rows_in = found.select("s.h", "y", "s.t").repartition(PARTS, "h")
    alike = map_arrow(rows_in, keyed, "h bigint, y int, t string, k bigint").groupBy("k", "y")
    train = written(alike.agg(F.min(F.struct("h", "t"))["t"].alias("t")).select("y", "t").repartition(PARTS, F.xxhash64("t")), "labelled-texts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())  # of clean and toxic texts

        def out():
            forms = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(forms, pa.string()), *[pa.array([c[f] for f in forms], pa.int64()) for c in counts]]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["form", "clean", "toxic"])

        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[y > 0].update(_forms(t.as_py()))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield out()
        yield out()

    every = map_arrow(train, counted, "form string, clean bigint, toxic bigint").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    pure = every.filter((F.col("toxic") >= LEAST) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean"))))
    candidates = {r["form"]: (r["toxic"], r["clean"]) for r in pure.toLocalIterator()}  # bounded by the labelled rows

    shared = docs.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [sorted(_forms(t.as_py()) & shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.list_(pa.string()))], names=["y", "forms"])

    collected = map_arrow(train, held, "y int, forms array<string>").collect()
    texts_in = sorted((r["y"] > 0, r["forms"]) for r in collected)
    toxic = sum(y for y, _ in texts_in)
    base = math.log((toxic + 1) / (len(texts_in) - toxic + 1))
    weights = dict.fromkeys(INSULTS, PRIOR_WEIGHT)
    for form in choose(texts_in):
        a, b = candidates[form]
        weights[form] = max(0.5, math.log((a + 0.5) / (b + 0.5)) - base)
    grammar = Grammar(weights)
    if not texts_in:
        return grammar

    lexicon = docs.sparkSession.sparkContext.broadcast(weights)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(lexicon.value)
        for batch in batches:
            rows = [own.evidence(own.matches(t.as_py())).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    seen = map_arrow(train, weighed, "y int, x array<double>").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([float(r["y"] > 0) for r in seen])
    worth, grammar.bias = _descend(x, y, _prior_worth(), base)
    grammar.worth = dict(zip(KINDS, worth.tolist()))
    return grammar


def score(docs: DataFrame, grammar: Grammar, text: str = "text", id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, *keep, score) per row, from the whole text alone.

    Null and empty texts and texts without a match score what the absence of
    matches is worth. Repeated rows get equal scores; an empty table gives no row;
    no kept column's name clashes.
    """
    names = [id, *(keep or [])]
    rows, kinds, at = with_text(docs, names, text)
    places = rows.columns[: len(names)]
    shared = docs.sparkSession.sparkContext.broadcast((grammar.insults, grammar.threats, grammar.worth, grammar.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shared.value)
        for batch in batches:
            scores = pa.array([own.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], scores], names=[*places, "_score"])

    return map_arrow(rows, run, ", ".join([*kinds, "_score double"])).toDF(*names, "score")


def predicted(score: str | Column = "score") -> Column:
    return ((F.col(score) if isinstance(score, str) else score) >= PREDICTED).cast("int")


def clean(docs: DataFrame, grammar: Grammar, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, as they are, that are not predicted toxic; no shuffle."""
    found = score(docs, grammar, text, id, keep=[c for c in docs.columns if c != id])
    return keep_rows(found, docs, id, lambda value: predicted(value) == 0)
