"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's bytes are cut into windows of `WINDOW`. Two recurrences, one from each end, run through all windows of a step at once; at every
position a softmax layer reads both states and labels the position; a document's probabilities are the means over all its
positions. So texts of any length are read whole, in steps of bounded size.

Training reads at most `ROWS` texts for each of at most `LANGUAGES` languages (the most frequent), chosen by a hash of the
text, and `PIECES` windows of each, spread over the whole text. Windows are sorted before they are shuffled by a fixed seed, so the model does
not depend on how rows are partitioned. lang, source and doc_id never enter a prediction.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is every text when there is nothing to
learn from; rows with a null id count as not held out; equal rows give equal results, one for each; with one language in the
training rows every text gets it; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import steps, utf8

WINDOW = 96
HIDDEN = 16
ROWS, PIECES, LANGUAGES = 400, 3, 64
EPOCHS, BATCH, RATE = 4, 128, 0.02
#: Windows that run side by side when texts are labelled.
SIDE = 1024
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3: never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the squashing function here: it costs a fifth of a hyperbolic tangent; its slope is (1 - |soft|) ** 2."""
    return x / (1 + np.abs(x))


def slope(s: np.ndarray) -> np.ndarray:
    d = 1 - np.abs(s)
    return d * d


def layout(lens: np.ndarray, starts: np.ndarray, buf: np.ndarray, width: int) -> np.ndarray:
    """Codes (width, 2, n) of windows: their bytes, and 256 more than their bytes from the end; 0 beyond a window."""
    at = np.arange(width)[:, None]
    inside = at < lens
    ahead = np.where(inside, buf[np.minimum(starts + at, max(0, len(buf) - 1))] if len(buf) else 0, 0).astype(np.int64)
    back = np.where(inside, buf[np.maximum(starts + lens - 1 - at, 0)] if len(buf) else 0, 0).astype(np.int64)
    return np.stack([ahead, back + 256], axis=1)


class Network:
    """`e` (512, 3H) what a byte adds to the gates of either direction, `u` (2, H, 3H) recurrent weights, `w` (2, H, L) and `b` the labels' layer.

    Gates: update z and reset r = (1 + soft(e + h u)) / 2, candidate c = soft(e + r * (h u)); the next state is h + z (c - h)."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7, kind=np.float32):
        rng = np.random.default_rng(seed)
        n = len(languages)
        self.languages, self.hidden = languages, hidden
        self.e = rng.normal(0, 0.3, (512, 3 * hidden)).astype(kind)
        self.e[:, :hidden] -= 1.0  # slow updates at first: states carry further
        self.u = (rng.normal(0, 1, (2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(kind)
        self.w = (rng.normal(0, 1, (2, hidden, n)) / np.sqrt(2 * hidden)).astype(kind)
        self.b = np.zeros(n, kind)

    def params(self) -> list[np.ndarray]:
        return [self.e, self.u, self.w, self.b]

    def run(self, codes: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """What either direction adds to the labels at each step (width, 2, n, L), of windows sorted from long to short, `live[t]` of them
        longer than t; and what training needs of each step."""
        width, _, n = codes.shape
        hid = self.hidden
        out = np.zeros((width, 2, n, len(self.b)), self.e.dtype)
        h, saved = np.zeros((2, n, hid), self.e.dtype), []
        for t in range(width):
            k = live[t]
            if not k:
                break
            before = h[:, :k]
            a = np.take(self.e, codes[t, :, :k], axis=0)
            g = before @ self.u
            s = soft(a[..., : 2 * hid] + g[..., : 2 * hid])
            gates = 0.5 * s + 0.5
            z, r = gates[..., :hid], gates[..., hid:]
            c = soft(a[..., 2 * hid :] + r * g[..., 2 * hid :])
            now = before + z * (c - before)
            if keep:
                saved.append((before.copy(), s, z, r, c, g[..., 2 * hid :], now))
            h[:, :k] = now
            out[t, :, :k] = now @ self.w
        return out, saved

    def label(self, out: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Probabilities (width, n, L) at every position; those beyond a window mean nothing."""
        width, _, n, _ = out.shape
        turned = np.maximum(lens[None, :] - 1 - np.arange(width)[:, None], 0)
        back = out[::-1, 1] if lens[-1] == width else out[turned, 1, np.arange(n)[None, :]]
        x = out[:, 0] + back + self.b
        x -= x.max(axis=2, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=2, keepdims=True)
        return x

    def gradients(self, codes: np.ndarray, lens: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the positions of windows (sorted from long to short, one language each) and its gradients."""
        width, _, n = codes.shape
        live = (lens[None, :] > np.arange(width)[:, None]).sum(axis=1)
        seen, saved = self.run(codes, live, keep=True)
        p = self.label(seen, lens)
        inside = np.arange(width)[:, None] < lens[None, :]
        count = max(1, int(lens.sum()))
        loss = float(-(np.log(np.maximum(p[:, np.arange(n), y], 1e-30)) * inside).sum() / count)
        d = p.copy()
        d[:, np.arange(n), y] -= 1
        d *= (inside / count)[..., None].astype(d.dtype)
        turned = np.maximum(lens[None, :] - 1 - np.arange(width)[:, None], 0)
        # d at the steps of the second direction: a turn within each window undoes itself
        d_back = d[turned, np.arange(n)[None, :]] * inside[..., None]
        out = np.stack([d, d_back], axis=1)
        g_w, g_b = np.zeros_like(self.w), d.sum(axis=(0, 1))
        g_u, d_e = np.zeros_like(self.u), np.zeros((width, 2, n, 3 * self.hidden), self.e.dtype)
        dh = np.zeros((2, n, self.hidden), self.e.dtype)
        for t in range(len(saved) - 1, -1, -1):
            before, s, z, r, c, gc, now = saved[t]
            k = live[t]
            g_w += now.transpose(0, 2, 1) @ out[t, :, :k]
            g = dh[:, :k] + out[t, :, :k] @ self.w.transpose(0, 2, 1)
            bend = 0.5 * slope(s)
            a_c = g * z * slope(c)
            a_z = g * (c - before) * bend[..., : self.hidden]
            a_r = a_c * gc * bend[..., self.hidden :]
            gates = np.concatenate([a_z, a_r, a_c * r], axis=2)
            g_u += before.transpose(0, 2, 1) @ gates
            d_e[t, :, :k, : 2 * self.hidden] = gates[..., : 2 * self.hidden]
            d_e[t, :, :k, 2 * self.hidden :] = a_c
            dh[:, :k] = g * (1 - z) + gates @ self.u.transpose(0, 2, 1)
        g_e = np.zeros_like(self.e)
        code, rows = codes.ravel(), d_e.reshape(-1, 3 * self.hidden)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
        g_e[code[order][first]] = np.add.reduceat(rows[order], first, axis=0)
        return loss, [g_e, g_u, g_w, g_b]

    def fit(self, windows: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
        buf = np.frombuffer(b"".join(windows), np.uint8)
        lens = np.array([len(w) for w in windows])
        starts = np.cumsum(lens) - lens
        rng, step = np.random.default_rng(seed), 0
        first, second = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()]
        total = epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                rows = rows[np.argsort(-lens[rows], kind="stable")]
                _, grads = self.gradients(layout(lens[rows], starts[rows], buf, WINDOW), lens[rows], y[rows])
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                rate = RATE * (1 - step / total)
                step += 1
                for p, g, m, v in zip(self.params(), grads, first, second):
                    g = g * min(1.0, 1.0 / max(size, 1e-12))
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities (n, L) of texts, the means over all positions; zeros for an empty text."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = offsets[doc] + nth * WINDOW
        lens = np.minimum(WINDOW, offsets[doc + 1] - starts)
        order = np.argsort(-lens, kind="stable")
        sums = np.zeros((len(sizes), len(self.languages)))
        for at in range(0, len(order), SIDE):
            rows = order[at : at + SIDE]
            width = int(lens[rows[0]])
            live = (lens[rows][None, :] > np.arange(width)[:, None]).sum(axis=1)
            p = self.label(self.run(layout(lens[rows], starts[rows], buf, width), live)[0], lens[rows])
            p *= (np.arange(width)[:, None] < lens[rows][None, :])[..., None]
            np.add.at(sums, doc[rows], p.sum(axis=0, dtype=np.float64))
        return sums / np.maximum(sizes, 1)[:, None]


def sample(docs: DataFrame) -> DataFrame:
    """lang, piece: windows of a bounded number of texts for each language, all distinct texts of it if there are fewer."""
    known = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")) & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES)
    # a share of the hash values that holds about three times the rows wanted, so that ranking has a bounded input
    share = F.least(F.lit(1.0), F.lit(3.0 * ROWS + 100) / F.col("n"))
    few = known.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < F.col("share"))
    raw = F.col("text").cast("binary")
    pieces = F.ceil(F.octet_length(raw) / WINDOW)
    chosen = F.array_distinct(F.array(*(F.pmod(F.xxhash64("h", F.lit(k)), pieces) for k in range(PIECES))))
    cut = F.transform(chosen, lambda i: F.substring(raw, (i * WINDOW + 1).cast("int"), F.lit(WINDOW)))
    one = few.select("lang", "h", cut.alias("pieces")).groupBy("lang", "h").agg(F.min("pieces").alias("pieces"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return one.withColumn("rank", rank).where(F.col("rank") <= ROWS).select("lang", F.explode("pieces").alias("piece"))


def fit(docs: DataFrame) -> Network | None:
    """The network trained on a bounded sample of the rows that are not held out; None without any."""
    rows = sorted((r["lang"], bytes(r["piece"])) for r in sample(docs).collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    y = np.array([languages.index(lang) for lang, _ in rows])
    return Network(languages).fit([piece for _, piece in rows], y)


def predict(docs: DataFrame, model: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), has_letter(F.col("text")).alias("letters"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for step in steps(batches, 3):
            letters = step.column(2).to_numpy(zero_copy_only=False)
            if model is None:
                best, score, names = np.zeros(len(letters), int), np.zeros(len(letters)), [UNKNOWN]
                letters = np.zeros(len(letters), bool)
            else:
                p, names = model.documents(*utf8(step.column(3))), model.languages
                best, score = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
            found = pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, letters)], pa.string())
            yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), found, pa.array(np.where(letters, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    columns = [T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *columns]))
