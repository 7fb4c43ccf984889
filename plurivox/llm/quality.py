"""Quality filter: hierarchical empirical Bayes over documents, paths and hosts.

A logistic classifier over binned text statistics gives each document its evidence: prior log-odds z of good quality.
Sites add what the labels of their documents say beyond that prior. For a site, `score` is the sum of label - p and `info` the sum of
p (1 - p) over its labelled documents, p being the prior probability; a site whose documents shift by d in log-odds has a score near d * info.
Grouped aggregation takes these sums by path and by host. Method-of-moments variances of the shifts of hosts, and of
paths around their hosts, then give posterior means: a host's shift is shrunk toward the global one, a path's toward
its host's, so sparse sites stay near their parents. A document's posterior log-odds are its own evidence plus the shift of its path,
or of its host, or the global one, the first that has labels. A labelled document is left out of its own site's sums.
Documents under `KEEP` are rejected.

Here the host of a document is its source up to the first slash, and its path the rest of the source and its language.

The classifier is trained on at most `SAMPLE` labelled rows (those of the smallest hashed ids); site sums cover all
labelled documents.

Defined cases: null, empty and wordless texts get the evidence of all-zero statistics; null sources, paths and
languages form sites of their own; null ids have no label; repeated rows are scored row by row, and each of them counts for its
site; of several labels of one id the largest counts; without labels of both classes every document gets the one class's smoothed
rate as its prior; other columns are kept by `judge` and `keep`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .toxicity import _FUNCTION, _has, _PUNCT

SAMPLE = 12_000
BINS = 12
KEEP = 0.5
#: Sites and labels that are broadcast at most; more are joined by a shuffle.
BROADCAST_SITES = 500_000
BROADCAST_LABELS = 2_000_000
#: Text bytes that one numpy step holds.
STEP = 1 << 20
#: Widest prior of a shift in log-odds.
WIDEST = 4.0

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 letters and others, 1 digits, 2 capitals, 3 symbols, 4 ends of sentences
_CLASS[48:58], _CLASS[65:91] = 1, 2
_CLASS[[*range(35, 39), 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)]] = 3
_CLASS[[33, 44, 46, 63]] = 4


def statistics(col: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    raw, offsets = shared.utf8(col)
    words, plain = shared.Words(col), shared.Words(col, chars=_PUNCT)
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    seen = [np.r_[0, np.cumsum(_CLASS[raw] == k, dtype=np.int32)] for k in range(1, 5)]
    count = np.maximum(np.diff(words.first), 1)
    per = lambda flags, of: np.bincount(of[flags], minlength=n) / count
    h, doc = words.hash, words.doc
    out = [(c[offsets[1:]] - c[offsets[:-1]]) / size for c in seen]
    out.append(np.log1p(np.diff(words.first)))
    out.append(np.bincount(doc, weights=words.ends - words.starts, minlength=n) / count)
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.zeros(0, bool)
    out.append(per(same, doc))
    for width in (1, 3):
        w = h if width == 1 else shared.window_hash(h, width)[shared.window_ok(words, width)]
        d = doc if width == 1 else doc[: max(0, len(h) - width + 1)][shared.window_ok(words, width)]
        order = np.lexsort((w, d))
        again = np.r_[False, (w[order][1:] == w[order][:-1]) & (d[order][1:] == d[order][:-1])] if len(w) else np.zeros(0, bool)
        out.append(per(again, d[order]))
    out.append(per(_CLASS[words.buf[words.ends - 1]] == 3, doc) if len(h) else np.zeros(n))
    out.append(per((words.ends - words.starts) == 1, doc))
    known = np.zeros(len(plain.hash), bool)
    for values in _FUNCTION.values():
        known |= _has(values, plain.hash) if len(plain.hash) else known
    out.append(np.bincount(plain.doc[known], minlength=n) / count)
    return np.stack(out, axis=1)


class Model:
    """Logistic regression over the bins of each statistic."""

    def __init__(self, bias: float = 0.0):
        self.edges: list[np.ndarray] = []
        self.w, self.b = np.zeros(0), bias

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") + k * (BINS + 1) for k, e in enumerate(self.edges)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.b + (self.w[self._bins(x)].sum(axis=1) if self.edges else np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        self.edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])]
        # rare values at the ends get bins of their own, for the rarer class often sits there
        rare = x[y == (0 if y.mean() > 0.5 else 1)]
        self.edges = [np.unique(np.r_[e, np.quantile(rare[:, k], [0.5])])[:BINS] for k, e in enumerate(self.edges)]
        bins = self._bins(x)
        self.w, self.b = np.zeros(x.shape[1] * (BINS + 1)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        g2 = np.full(len(self.w), 1e-8)
        for _ in range(400):
            p = 1 / (1 + np.exp(-(self.b + self.w[bins].sum(axis=1))))
            r = np.repeat(p - y, bins.shape[1])
            g = np.bincount(bins.ravel(), weights=r, minlength=len(self.w)) / len(y) + self.w * (2.0 / len(y))
            g2 += g * g
            self.w -= 0.3 * g / np.sqrt(g2)
            self.b -= 0.3 * float((p - y).mean())
        return self


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality: one label an id."""
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier; executors turn texts into statistics, so a bounded table of numbers reaches the driver."""
    chosen = known_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches, size=STEP):
            x = statistics(step.column(2))
            yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), pa.array([row.tobytes() for row in x.astype("<f8")], pa.binary())], names=["doc_id", "y", "x"])

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("y", T.DoubleType()), T.StructField("x", T.BinaryType())])
    # rows of one id count once: the smallest of their statistics, whatever the order of tasks
    found = rows.mapInArrow(run, schema).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    y = found.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.9
        return Model(float(np.log(rate / (1 - rate))))
    return Model().fit(np.frombuffer(b"".join(found.column("x").to_pylist()), "<f8").reshape(len(y), -1), y)


def with_evidence(docs: DataFrame, model: Model, name: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """`docs` (without its text where `drop_text`) and the classifier's log-odds of each text as `name`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = next(k for k, f in enumerate(docs.schema) if f.name == text)
    fields = [f for k, f in enumerate(docs.schema) if k != text or not drop_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches, text=text, size=STEP):
            columns = [c for k, c in enumerate(step.columns) if k != text or not drop_text]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(held.value.logits(statistics(step.column(text))))], names=[*(f.name for f in fields), name])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def _site(docs: DataFrame) -> tuple[Column, Column]:
    source = F.coalesce(docs["source"].cast("string"), F.lit(""))
    rest = F.when(F.instr(source, "/") > 0, F.regexp_replace(source, "^[^/]*/", "")).otherwise("")
    return F.substring_index(source, "/", 1), F.concat_ws("/", rest, F.coalesce(docs["lang"].cast("string"), F.lit("")))


def _variance(score: str, info: str) -> Column:
    """Variance of the groups' shifts: the sum of score ** 2 is expected to be that of info + info ** 2 * variance."""
    s, i = F.col(score), F.col(info)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(WIDEST), F.sum(s * s - i) / F.sum(i * i))), F.lit(0.0))


def outcomes(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `scored` (doc_id, host, path, z) that have a label, with score and info."""
    known = known_labels(labels)
    rows = scored.join(F.broadcast(known) if known.count() <= BROADCAST_LABELS else known, "doc_id")
    p = 1 / (1 + F.exp(-F.col("z")))
    return rows.select("doc_id", "host", "path", (F.col("quality") - p).alias("score"), (p * (1 - p)).alias("info"))


def sites(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Sums of paths (host, path, score, info, variance of paths around their host, and the host's columns), sums of hosts
    (host, host_score, host_info, host_variance, prior: the host's posterior shift) and the global shift."""
    by_path = shared.written(labelled.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("info").alias("info")), "quality-paths")
    by_host = shared.written(by_path.groupBy("host").agg(F.sum("score").alias("host_score"), F.sum("info").alias("host_info")), "quality-hosts")
    # the global shift has a unit prior; a host's outcomes are taken relative to it, a path's relative to its host
    score, info = by_host.agg(F.coalesce(F.sum("host_score"), F.lit(0.0)), F.coalesce(F.sum("host_info"), F.lit(0.0))).first()
    top = score / (info + 1)
    hosts = by_host.withColumn("rest", F.col("host_score") - top * F.col("host_info"))
    hosts = hosts.withColumn("host_variance", F.lit(hosts.agg(_variance("rest", "host_info")).first()[0]))
    prior = top + F.col("rest") * F.col("host_variance") / (1 + F.col("host_info") * F.col("host_variance"))
    hosts = shared.written(hosts.withColumn("prior", prior).drop("rest"), "quality-shifts")
    paths = by_path.join(hosts, "host").withColumn("rest", F.col("score") - F.col("prior") * F.col("info"))
    return paths.withColumn("variance", F.lit(paths.agg(_variance("rest", "info")).first()[0])).drop("rest"), hosts, top


def _shift(own_score: Column, own_info: Column) -> Column:
    """A document's shift: its site's posterior without what the document itself has given to the sums."""
    host = (F.col("host_score") - own_score) - F.col("top") * (F.col("host_info") - own_info)
    prior = F.col("top") + host * F.col("host_variance") / (1 + (F.col("host_info") - own_info) * F.col("host_variance"))
    path = (F.col("score") - own_score) - prior * (F.col("info") - own_info)
    return prior + path * F.col("variance") / (1 + (F.col("info") - own_info) * F.col("variance"))


def judged(scored: DataFrame, own: DataFrame) -> DataFrame:
    """`scored` (doc_id, host, path, z and others) with shift and posterior, from the labelled documents' parts `own`."""
    paths, hosts, top = sites(own)
    paths, hosts = shared.written(paths.select("host", "path", "score", "info", "variance"), "quality-path-shifts"), hosts.drop("prior")
    parts = own.groupBy("doc_id").agg(F.max("score").alias("own_score"), F.max("info").alias("own_info"))
    small = lambda t, most: F.broadcast(t) if t.count() <= most else t
    rows = scored.join(small(paths, BROADCAST_SITES), ["host", "path"], "left").join(small(hosts, BROADCAST_SITES), "host", "left").join(small(parts, BROADCAST_LABELS), "doc_id", "left")
    # a site without labels has no sums: its shift is its parent's
    rows = rows.fillna(0.0, ["score", "info", "variance", "host_score", "host_info", "host_variance", "own_score", "own_info"]).withColumn("top", F.lit(top))
    rows = rows.withColumn("shift", _shift(F.col("own_score"), F.col("own_info")))
    return rows.withColumn("posterior", 1 / (1 + F.exp(-(F.col("z") + F.col("shift")))))


def judge(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, host, path, evidence, shift, posterior (probability of good quality), keep; each text is scored once."""
    model = model or fit(docs, labels)
    host, path = _site(docs)
    rows = docs.select("doc_id", host.alias("host"), path.alias("path"), "text")
    scored = shared.written(with_evidence(rows, model, "z", drop_text=True), "quality-scored")
    own = shared.written(outcomes(scored, labels), "quality-outcomes")
    out = judged(scored, own)
    return out.select("doc_id", "host", "path", F.col("z").alias("evidence"), "shift", "posterior", (F.col("posterior") >= KEEP).alias("keep"))


def keep(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs` that are not rejected, with its columns; the texts of labelled documents are scored first, for the sites."""
    model = model or fit(docs, labels)
    host, path = _site(docs)
    known = known_labels(labels).select("doc_id")
    rows = docs.select("doc_id", host.alias("host"), path.alias("path"), "text")
    rows = rows.join(F.broadcast(known) if known.count() <= BROADCAST_LABELS else known, "doc_id", "left_semi")
    own = shared.written(outcomes(with_evidence(rows, model, "z", drop_text=True), labels), "quality-outcomes")
    # the columns of `docs` travel under names of their own, so that none of them clashes
    host, path = _site(docs)
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*(docs[c].alias(n) for c, n in zip(docs.columns, names)), docs["doc_id"].alias("doc_id"), host.alias("host"), path.alias("path"))
    out = judged(with_evidence(rows, model, "z", names[docs.columns.index("text")]), own)
    return out.where(F.col("posterior") >= KEEP).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def digest(judged: DataFrame) -> DataFrame:
    """The columns of op7."""
    return judged.select("doc_id", "host", "path", *(F.round(c, 9).alias(c) for c in ("evidence", "shift", "posterior")), "keep")
