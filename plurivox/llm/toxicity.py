"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed rows of the word and of its first bytes, so unseen forms of a known stem
have one. Filters of several widths slide over the embedded words of the whole
text, each keeps its maximum over all places, and a logistic layer reads the maxima. The first filter of each width
starts as a detector of words with high smoothed log-odds in the training rows; embeddings, filters and output layer
are then trained together by Adam with gradients through the maxima. Texts are scored by per-bucket filter responses,
in steps of bounded size, so a text's length does not matter.

Thresholds are calibrated by language: the language is guessed from the text's own function words (never from a
column), a threshold per guessed language is chosen on training rows held out from the fit, shrunk to the common one
where a language has few rows, and scores are shifted so that each language's threshold stands at `CUT`.

Training reads at most `SAMPLE` labelled rows (those of the smallest hashed ids; the first text in order where an id has
several), sorted, so that the model does not depend on how rows are partitioned. Labels serve only for training; lang,
source and doc_id never enter a score.

Defined cases: null, empty and wordless texts get the score of a text without words; a null doc_id and repeated rows
give one result row per input row; without labels of both classes the score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SAMPLE = 12_000
BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
EPOCHS = 4
CUT = 0.7
#: Rows of a guessed language that weigh as much as the common threshold.
SHRINK = 50
#: Texts in one step of the trainer.
BATCH = 64

# Function words by which a language is guessed (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with be this are from",
    "fr": "le les des et la est dans que pour une du qui sur pas au",
    "de": "der die und das den von zu mit ist des sich nicht auf ein im",
    "es": "el la los de que y en las por con para una del se su",
}
LANGS = ("und", *FUNCTION_WORDS)
_PUNCT = np.ones(256, dtype=bool)
_PUNCT[[*range(0, 48), *range(58, 97), *range(123, 128)]] = False


def _hash(words: list[str]) -> np.ndarray:
    return shared.Words(pa.array([" ".join(words)], pa.string()), chars=_PUNCT).hash


_FUNCTION = {name: np.sort(_hash(ws.split())) for name, ws in FUNCTION_WORDS.items()}


def _has(sorted_values: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)] == h


def guess(words: shared.Words) -> np.ndarray:
    """Index in LANGS of each row's language: most function words, und without any."""
    n = len(words.first) - 1
    counts = np.zeros((n, len(LANGS)))
    for k, name in enumerate(LANGS[1:], 1):
        counts[:, k] = np.bincount(words.doc[_has(_FUNCTION[name], words.hash)], minlength=n)
    counts[:, 0] = 0.5
    return counts.argmax(axis=1)


#: Bytes of the hashed word beginnings.
STEMS = (4, 5)


def prepare(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and of its beginnings, n + 1 word offsets, guessed language of each row."""
    words = shared.Words(col, chars=_PUNCT)
    parts = [words.hash] + [shared.mix(shared.hash_spans(words.buf, words.starts, np.minimum(words.ends, words.starts + n)) + np.uint64(n)) for n in STEMS]
    return np.stack([(h >> np.uint64(47)).astype(np.int32) for h in parts], axis=1), words.first, guess(words)


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.f = [rng.normal(0, 0.3, (FILTERS, w, DIM)).astype(np.float32) for w in WIDTHS]
        self.fb = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        self.o = np.full(len(WIDTHS) * FILTERS, 0.1, dtype=np.float32)
        self.b = np.float32(-2.0)
        self.constant: float | None = None
        self.cuts = np.full(len(LANGS), 0.5)

    def maxima(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each row (0 without a place), and the place of it (-1 without)."""
        n = len(first) - 1
        best, where = np.zeros((n, len(self.o)), np.float32), np.full((n, len(self.o)), -1)
        lens = np.diff(first)
        x = self.e[buckets[:, 0]]
        for c in range(1, buckets.shape[1]):
            x += self.e[buckets[:, c]]
        for k, w in enumerate(WIDTHS):
            rows = np.flatnonzero(lens >= w)
            if not len(rows):
                continue
            m = len(buckets) - w + 1
            r = x[:m] @ self.f[k][:, 0].T + self.fb[k]
            for j in range(1, w):
                r += x[j : j + m] @ self.f[k][:, j].T
            # places whose window leaves its row never win
            over = (first[1:-1, None] - np.arange(1, w)).ravel()
            r[over[(over >= 0) & (over < m)]] = -1e9
            cut = first[rows]
            top = np.maximum.reduceat(r, cut, axis=0)
            c = slice(k * FILTERS, (k + 1) * FILTERS)
            best[rows, c] = np.maximum(top, 0)
            if self.train:
                owner = np.searchsorted(cut, np.arange(m), side="right") - 1
                for q in range(FILTERS):
                    hit = np.flatnonzero((r[:, q] == top[owner, q]) & (r[:, q] > 0))
                    where[rows[owner[hit[::-1]]], k * FILTERS + q] = hit[::-1]
        return best, where

    train = False

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.maxima(buckets, first)[0] @ self.o + self.b

    def fit(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Model:
        # words with high log-odds of presence start out large in dimension 0
        pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for t, label in zip(texts, y):
            (pos if label else neg)[np.unique(t)] += 1
        odds = np.log((pos + 0.3) / (y.sum() + 1)) - np.log((neg + 0.3) / (len(y) - y.sum() + 1))
        self.e[:, 0] = np.clip(odds, -1, 3) * (pos + neg > 0)
        for f in self.f:
            f[0] = 0
            f[0, :, 0] = 1.0
        self.fb[:, 0] = -1.0
        self.o[::FILTERS] = [2.0, 0.3, 0.2]
        self.train = True
        rng, step = np.random.default_rng(seed), 0
        params = [*self.f, self.fb, self.o]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = np.where(y == 1, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, len(y) - y.sum()))
        weight = np.sqrt(weight)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                part = [texts[k] for k in rows]
                first = np.r_[0, np.cumsum([len(t) for t in part])]
                buckets = np.concatenate(part)
                best, where = self.maxima(buckets, first) if len(buckets) else (np.zeros((len(rows), len(self.o)), np.float32), np.full((len(rows), len(self.o)), -1))
                p = 1 / (1 + np.exp(-(best @ self.o + self.b)))
                g = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                grads = [np.zeros_like(x) for x in params]
                grads[-1][:] = best.T @ g + 1e-4 * self.o
                through = g[:, None] * self.o[None]
                for k, w in enumerate(WIDTHS):
                    for q in range(FILTERS):
                        c = k * FILTERS + q
                        live = np.flatnonzero(where[:, c] >= 0)
                        if not len(live):
                            continue
                        gr, place = through[live, c], where[live, c]
                        grads[-2][k, q] = gr.sum()
                        for j in range(w):
                            b = buckets[place + j]
                            grads[k][q, j] = gr @ self.e[b].sum(axis=1)
                            np.add.at(self.e, b.ravel(), np.repeat(-0.2 * gr[:, None] * self.f[k][q, j], b.shape[1], axis=0))
                step += 1
                for x, gx, mx, vx in zip(params, grads, m, v):
                    mx += 0.1 * (gx - mx)
                    vx += 0.001 * (gx * gx - vx)
                    x -= 0.01 * (mx / (1 - 0.9**step)) / (np.sqrt(vx / (1 - 0.999**step)) + 1e-8)
                self.b -= np.float32(0.3 * g.sum())
        self.train = False
        return self

    def calibrate(self, p: np.ndarray, y: np.ndarray, lang: np.ndarray) -> Model:
        """Thresholds of best F1, common and by guessed language."""

        def best(p: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(-p, kind="stable")
            hit = np.cumsum(y[order])
            f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
            k = int(f1.argmax())
            return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0)) / 2)

        common = best(p, y) if y.any() else 0.5
        for k in range(len(LANGS)):
            own = lang == k
            n = int(own.sum()) if y[own].any() else 0
            self.cuts[k] = ((best(p[own], y[own]) if n else 0) * n + common * SHRINK) / (n + SHRINK)
        self.cuts = np.clip(self.cuts, 0.02, 0.98)
        return self

    def score(self, buckets: np.ndarray, first: np.ndarray, lang: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(lang), self.constant)
        z = self.logits(buckets, first) if len(buckets) else np.full(len(lang), self.b, dtype=np.float64)
        cut = self.cuts[lang]
        z = np.clip(z.astype(np.float64) - np.log(cut / (1 - cut)) + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3: never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one row an id, in a fixed order: folds, descent and calibration follow the order of rows
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").toArrow()
    model = Model()
    y = rows.column("toxic").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    texts, langs = [], []
    for step in shared.steps(iter(rows.to_batches())):
        buckets, first, lang = prepare(step.column("text"))
        texts += [buckets[a:b] for a, b in zip(first, first[1:])]
        langs.append(lang)
    lang = np.concatenate(langs)
    # thresholds come from rows that a first fit did not see; the kept weights from all rows
    fold = np.arange(len(y)) % 4 == 3
    if y[fold].any() and y[~fold].any():
        first_fit = Model().fit([t for t, f in zip(texts, fold) if not f], y[~fold])
        kept = [t for t, f in zip(texts, fold) if f]
        z = np.concatenate([first_fit.logits(t, np.array([0, len(t)])) if len(t) else np.array([first_fit.b]) for t in kept])
        model.calibrate(1 / (1 + np.exp(-np.clip(z, -30, 30))), y[fold], lang[fold])
    return model.fit(texts, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, lang_guess."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    columns = [T.StructField("score", T.DoubleType()), T.StructField("lang_guess", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches):
            buckets, first, lang = prepare(step.column(1))
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(held.value.score(buckets, first, lang)), pa.array([LANGS[k] for k in lang])], names=["doc_id", "score", "lang_guess"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *columns]))


def digest(scored: DataFrame) -> DataFrame:
    """The columns of op6."""
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "lang_guess")
