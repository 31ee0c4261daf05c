"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.workers import keep_rows, map_arrow, with_text

SAMPLE_ROWS = 3000  # labelled rows the model is fitted on, at most
PARTS = 16  # tasks that the sampled texts are dealt over
BUCKETS = 1 << 15
DIMENSIONS = 16
ORDERS = (2, 3, 4)  # bytes in a subword
EPOCHS = 6
RATE = 1.0
WRONGLY_REJECTED = 0.001  # share of labelled calibration rows that may fall below the threshold
SMOOTHING = 0.01  # calibration keeps this much doubt even where every row is told apart
CALIBRATION_SHARE = 5  # one in so many sampled rows calibrates

# ASCII letters are lower-cased, other ASCII bytes end a word.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
CHUNK = 1 << 18


def _subwords(folded: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of the byte n-grams inside words, with one blank at either end as word boundary."""
    wide = folded.astype(np.uint32)
    blank = folded == 0x20
    for n in ORDERS:
        size = len(folded) - n + 1
        if size <= 0:
            continue
        mixed = np.full(size, n, np.uint32)
        inner = np.zeros(size, bool)
        for k in range(n):
            mixed = mixed * np.uint32(0x01000193) + wide[k : k + size]
            if 0 < k < n - 1:
                inner |= blank[k : k + size]
        mixed = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
        yield mixed[~inner & ~(blank[:size] & blank[n - 1 : n - 1 + size])]


def _chunks(text: str) -> Iterator[np.ndarray]:
    """A whole text as blank-padded byte runs; a run starts where the last one's n-grams ended."""
    raw = (" " + text + " ").encode("utf-8", "surrogatepass").translate(_FOLD)
    folded = np.frombuffer(raw, np.uint8)
    folded = folded[np.r_[True, (folded[1:] != 0x20) | (folded[:-1] != 0x20)]]
    for start in range(0, max(1, len(folded) - 1), CHUNK):
        yield folded[start : start + CHUNK + max(ORDERS) - 1]


def subword_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts."""
    counts = np.zeros(BUCKETS, np.int64)
    for chunk in _chunks(text):
        for found in _subwords(chunk):
            counts += np.bincount(found, minlength=BUCKETS)
    which = np.flatnonzero(counts)
    return which.astype(np.int32), counts[which].astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    votes: np.ndarray  # buckets x languages: embeddings times softmax weights
    seen: np.ndarray  # buckets that occurred in the rows fitted on
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def confidence(self, logits: np.ndarray, known: np.ndarray | float) -> np.ndarray:
        """Softmax at the calibrated temperature; the share of subwords never seen votes for all languages alike."""
        known = np.asarray(known)[..., None]
        return known * _softmax(logits / self.temperature) + (1 - known) / len(self.langs)

    def predict(self, text: str) -> tuple[str, float]:
        total, n, known = np.zeros(len(self.langs)), 0, 0
        for chunk in _chunks(text):
            for found in _subwords(chunk):
                total += self.votes[found].sum(axis=0, dtype=np.float64)
                known += int(self.seen[found].sum())
                n += len(found)
        p = self.confidence(total / max(n, 1) + self.bias, known / max(n, 1))
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> Model | None:
    """Fit on (buckets, counts, lang) by stochastic gradient descent; None without rows.

    A part of the rows is kept from the descent: it sets the softmax temperature by
    likelihood and the rejection threshold, below which no more than
    ``WRONGLY_REJECTED`` of it falls.
    """
    langs = sorted({lang for *_, lang in rows})
    if not langs:
        return None
    place = {lang: k for k, lang in enumerate(langs)}
    data = [(b, c / c.sum(), place[lang]) for b, c, lang in rows if len(b)]
    held = data[::CALIBRATION_SHARE] if len(data) >= 10 * CALIBRATION_SHARE else []
    fit = [x for k, x in enumerate(data) if k % CALIBRATION_SHARE] if held else data
    random = np.random.default_rng(seed)
    embedding = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights = random.normal(0, 0.1, (DIMENSIONS, len(langs)))
    bias = np.zeros(len(langs))
    steps = max(1, EPOCHS * len(fit))
    for step in range(EPOCHS * len(fit)):
        if step % len(fit) == 0:
            order = random.permutation(len(fit))
        buckets, share, lang = fit[order[step % len(fit)]]
        mean = share @ embedding[buckets]
        error = _softmax(mean @ weights + bias)
        error[lang] -= 1
        rate = RATE * (1 - step / steps)
        back = weights @ error
        weights -= rate * np.outer(mean, error)
        bias -= 0.1 * rate * error
        # The mean divides each row's gradient by the text length; scaled back, so that long texts teach too.
        embedding[buckets] -= (rate * np.minimum(share * len(buckets), 4.0) * 0.1)[:, None] * back
    seen = np.zeros(BUCKETS, bool)
    for buckets, *_ in fit:
        seen[buckets] = True
    model = Model(langs, (embedding @ weights).astype(np.float32), seen, bias)
    if held:
        logits = np.stack([share @ model.votes[buckets].astype(np.float64) + bias for buckets, share, _ in held])
        truth = np.array([lang for *_, lang in held])
        grid = np.geomspace(0.05, 20, 60)
        logs = [np.log(_softmax(logits / t) + 1e-12) for t in grid]
        right = np.array([x[np.arange(len(truth)), truth].mean() for x in logs])
        any_lang = np.array([x.mean() for x in logs])
        model.temperature = float(grid[int(np.argmax((1 - SMOOTHING) * right + SMOOTHING * any_lang))])
        known = np.array([share[seen[buckets]].sum() for buckets, share, _ in held])
        sure = np.sort(model.confidence(logits, known).max(axis=1))
        model.threshold = float(min(0.5, sure[int(WRONGLY_REJECTED * len(sure))]))
    return model


def held_out(id: str = "doc_id", modulus: int = 5, remainder: int = 0) -> Column:
    """Whether a row is kept from learning: by crc32 of its id as text; rows without id are."""
    number = F.crc32(F.col(id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(number, F.lit(modulus)) == remainder, F.lit(True))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of at most ``rows`` labelled rows, those of the smallest id hashes.

    Of rows that share an id (or its hash) the one of the smallest language counts,
    then of the smallest text hash, then text. So equal tables give equal models,
    however their rows lie. Ids alone are read to find the sample; the tasks turn
    whole texts into bucket counts, so the driver holds at most ``rows`` x
    ``BUCKETS`` numbers.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.xxhash64(F.col(id), F.lit("sample")).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t")
    )
    last = known.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).head()[0]
    if last is None:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subword_counts(t.as_py()) for t in batch.column(2)]
            buckets = pa.array([b for b, _ in found], pa.list_(pa.int32()))
            counts = pa.array([c for _, c in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), buckets, counts], names=["h", "lang", "b", "c"])

    first = F.min(F.struct("lang", F.xxhash64("t").alias("x"), "t")).alias("r")
    sample = known.filter(F.col("h") <= last).groupBy("h").agg(first).select("h", "r.lang", "r.t").repartition(PARTS, "h")
    found = map_arrow(sample, counted, "h bigint, lang string, b array<int>, c array<float>").toArrow()
    table = sorted(zip(*(found.column(k).to_pylist() for k in range(2)), range(found.num_rows)))
    b, c = found.column(2), found.column(3)
    return train([(b[k].values.to_numpy(), c[k].values.to_numpy(), lang) for _, lang, k in table])


def identify(
    docs: DataFrame, model: Model | None, text: str = "text", id: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """(id, *keep, lang_pred, score, rejected) per row, from the text alone.

    A null text, one without a letter, or a missing model gives ``und`` with score
    0. ``rejected``: ``und`` or a score below the model's threshold. Repeated rows
    get equal answers; an empty table gives no row; no kept column name clashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages
    names = [id, *(keep or [])]
    rows, kinds, at = with_text(docs, names, text)
    rows = rows.withColumn("_letters", F.coalesce(F.col(rows.columns[at]).rlike(r"\p{L}"), F.lit(False)))

    places = rows.columns[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, letters = batch.column(at), batch.column(batch.num_columns - 1)
            found = [model.predict(t.as_py()) if model and y.as_py() else ("und", 0.0) for t, y in zip(texts, letters)]
            low = [lang == "und" or score < model.threshold for lang, score in found]
            columns = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64()), pa.array(low, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*places, "_lang", "_score", "_rejected"])

    found = map_arrow(rows, run, ", ".join([*kinds, "_lang string, _score double, _rejected boolean"]))
    return found.toDF(*names, "lang_pred", "score", "rejected")


def clean(docs: DataFrame, model: Model | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, as they are, whose language is told with enough confidence; no shuffle."""
    found = identify(docs, model, text, id, keep=[c for c in docs.columns if c != id])
    return keep_rows(found, docs, id, lambda lang, score, rejected: ~rejected)
