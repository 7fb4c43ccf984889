"""Language-model scoring by a hierarchical Pitman-Yor model.

Tokens are words, and one end for each text. Three levels of restaurants serve the tokens that follow a context: each
of the `CONTEXTS` most frequent words of the corpus has a restaurant of its own; its parent is the restaurant of the word's
class (`CLASSES` classes: short words by themselves, longer ones by their ending, and one for the start of a text), where the
tokens after all other words sit too; the classes share one parent, the restaurant of all tokens, whose base is
uniform over the known tokens and one unknown.

Seating is sampled by blocked Gibbs sweeps: all customers of one token in one restaurant are seated anew by the Chinese
restaurant process, given all other tables; customers of many dishes are seated together, exactly as one by one. Predictive probabilities are
averaged over the states after `BURN` sweeps. Discounts follow from the numbers of counts of one and two at each level;
concentrations are parameters.

On Spark: one pass counts words, for the contexts. In a second each step of documents sends its distinct (token, context) pairs,
with their training counts, by the token's bucket. A bucket holds all contexts of its tokens, so a sweep needs from the other
buckets only the customers and tables of each restaurant (a table of fixed size), which Spark adds up between sweeps. A
bucket's state is replayed from its seed and those sums, so a lost task is simply run again. The answers go back to the steps,
which meet their documents' tokens from a last pass over the texts and add them up by document. The passes must see the same rows in the same
order, as those of a stored table; a step whose text is another the second time raises an error. Answers travel in steps of 2 ** -27 of log10.

Training uses every document whose crc32(doc_id as text) mod 10 is not 0 (and those with a null id); every document is
scored whole. Tokens are compared by 64-bit hashes.

Defined cases: a null or empty text is one end token; repeated rows count and are scored as often as they occur; an
empty table returns no rows; without training text every probability is 1 in the base and the model; ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange, shared
from .shared import Tables, mix

#: Words with restaurants of their own.
CONTEXTS = 60_000
CLASSES = 32
START = CLASSES
SWEEPS = 4
BURN = 1
STRENGTH = 1.0
STEP = 8 << 20
#: Customers of a dish that are seated one by one before the others follow in blocks, and customers in a block.
SINGLY, BLOCK = 16, 1 << 18
#: Answers are whole multiples of this.
GRAIN = 2.0**-27
#: Parts of the table of sums, and tasks whose tables meet first.
CHUNKS, TASKS = 16, 64
_U = np.uint64
_END = _U(0x9D8E4F7E87A3C15B)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(words: shared.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token (64-bit hash), class and row of each token, ends included."""
    rows = len(words.first) - 1
    n = len(words.starts) + rows
    row = np.repeat(np.arange(rows), np.diff(words.first) + 1)
    is_word = np.ones(n, bool)
    is_word[words.first[1:] + np.arange(rows)] = False
    token, cls = np.full(n, _END, _U), np.full(n, START, np.uint8)
    token[is_word] = words.hash
    size = words.ends - words.starts
    tail = words.buf[words.ends - 1].astype(np.int64) * 7 + words.buf[np.maximum(words.ends - 2, 0)] * 31
    half = CLASSES // 2
    cls[is_word] = np.where(size <= 3, (words.hash >> _U(50)).astype(np.int64) % half, half + mix(tail.astype(_U)).astype(np.int64) % half)
    return token, cls, row


class Names:
    """The words with restaurants of their own (sorted hashes) and their classes."""

    def __init__(self, h: np.ndarray, cls: np.ndarray):
        order = np.argsort(h)
        self.h, self.cls, self.n = h[order], cls[order].astype(np.int64), len(h)

    def contexts(self, token: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The restaurant of each token: the number of the word before it, or n and the class of that."""
        own = self.n + cls.astype(np.int64)
        if self.n:
            at = np.minimum(np.searchsorted(self.h, token), self.n - 1)
            own = np.where((self.h[at] == token) & (cls != START), at, own)
        return np.r_[self.n + START, own[:-1]].astype(np.uint16) if len(own) else own.astype(np.uint16)

    def classes(self, u: np.ndarray) -> np.ndarray:
        return np.r_[self.cls, np.arange(CLASSES + 1)][u]


def frequent(docs: DataFrame) -> Names:
    """The CONTEXTS most frequent words of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches, size=STEP):
            token, cls, row = tokens(shared.Words(step.column(0)))
            h, first, count = np.unique(token[cls != START], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls[cls != START][first].astype(np.int32)), pa.array(count)], names=["h", "cls", "c"])

    rows = docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(run, "h long, cls int, c long")
    top = rows.groupBy("h").agg(F.sum("c").alias("c"), F.min("cls").alias("cls")).orderBy(F.desc("c"), "h").limit(CONTEXTS).toArrow()
    return Names(top["h"].to_numpy().view(_U), top["cls"].to_numpy())


def _pairs(part: pa.RecordBatch, names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct tokens of a step, its sorted distinct (token's place, context) pairs, and the pair and row of each token."""
    token, cls, row = tokens(shared.Words(part.column(1)))
    tok, place = np.unique(token, return_inverse=True)
    pair, code = np.unique((place.astype(_U) << _U(16)) | names.contexts(token, cls), return_inverse=True)
    return tok, pair, code, row


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    # a step's number follows from the input partition alone, so a task that runs again gives the same rows
    return enumerate(shared.steps(batches, size=STEP), TaskContext.get().partitionId() << 32)


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held"))


def _entries(docs: DataFrame, names, buckets: int) -> DataFrame:
    """Rows of each bucket and step: tokens, pairs of each token, and the contexts and training counts of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, part in _numbered(batches):
            tok, pair, code, row = _pairs(part, names.value)
            held = np.asarray(part.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            count = np.bincount(code[~held[row]], minlength=len(pair)).astype(np.uint32)
            at = ((tok >> _U(32)) * _U(buckets)) >> _U(32)  # rises with the token
            full, first = np.unique(at, return_index=True)
            cuts = np.r_[first, len(tok)]
            many = np.bincount((pair >> _U(16)).astype(np.int64), minlength=len(tok)).astype(np.uint32)
            ends = np.r_[0, np.cumsum(many)][cuts]
            blobs = [exchange.blob(tok, cuts), exchange.blob(many, cuts), exchange.blob((pair & _U(0xFFFF)).astype(np.uint16), ends), exchange.blob(count, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), step)), *blobs], names=["bucket", "step", "tok", "many", "u", "c"])

    return _inputs(docs).mapInArrow(run, "bucket int, step long, tok binary, many binary, u binary, c binary")


def _codes(docs: DataFrame, names) -> DataFrame:
    """Rows of each step: the tokens of its documents as places of its sorted pairs, and ids, sizes and flags of the documents."""
    listed = T.ArrayType(docs.schema["doc_id"].dataType)
    schema = T.StructType([T.StructField("step", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("pairs", T.LongType()), T.StructField("check", T.LongType()), T.StructField("ids", listed), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("held", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, part in _numbered(batches):
            tok, pair, code, row = _pairs(part, names.value)
            n = part.num_rows
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x)
            codes = zstandard.ZstdCompressor(level=1).compress(code.astype(np.int32).tobytes())
            sizes = pa.array(np.bincount(row, minlength=n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([step]), pa.array([codes], pa.binary()), pa.array([len(pair)]), pa.array([_check(tok)]), one(part.column(0)), one(sizes), one(part.column(2))], names=schema.names)

    return _inputs(docs).mapInArrow(run, schema)


def _check(tok: np.ndarray) -> int:
    """A sum over the tokens of a step or of a part of it."""
    return int(mix(tok).sum(dtype=_U).astype(np.int64))


# ---- seating --------------------------------------------------------------------------------


def _seat(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers of one dish, when a new table weighs `new` and an old dish its customers less d a table."""
    t = np.minimum(c, 1).astype(np.float64)
    live = np.flatnonzero(c > 1)
    for seated in range(1, SINGLY):
        if not len(live):
            return t
        a = new[live]
        t[live] += rng.random(len(live)) * (a + seated - d * t[live]) < a
        live = live[c[live] > seated + 1]
    seated = np.full(len(live), SINGLY)
    while len(live):
        # the next customers of as many dishes as make a block, of one dish at most a block
        size = np.minimum(c[live].astype(np.int64) - seated, BLOCK)
        k = max(1, int(np.searchsorted(np.cumsum(size), BLOCK, side="right")))
        t[live[:k]] += _block(new[live[:k]], seated[:k], size[:k], d, t[live[:k]], rng)
        seated[:k] += size[:k]
        left = seated < c[live]
        live, seated = live[left], seated[left]
    return t


def _block(new: np.ndarray, seated: np.ndarray, size: np.ndarray, d: float, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables that the next `size` customers of each dish open, after `seated` customers at `t` tables.

    A customer opens a table where his draw falls below a bound that rises with the tables opened before him. Bounds
    from too few tables find some of the openings; those raise the bounds, until no opening is new. As each customer's
    bound then follows from the openings before him, these are the openings of the process seated one by one."""
    dish = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    a = new[dish]
    draw = rng.random(len(dish))
    # opens where draw * (a + customers - d * tables) < a, with customers counted from the dish's own
    base = draw * (a + seated[dish] + (np.arange(len(dish)) - start[dish]) - d * t[dish])
    slope = draw * d
    opened = base < a
    while True:
        before = np.cumsum(opened) - opened
        before -= before[start][dish]
        now = base - slope * before < a
        if (now == opened).all():
            return np.add.reduceat(opened, start)
        opened = now


class Bucket:
    """The share of a bucket's tokens of all restaurants. `w` and `u`: token and context of each pair, `c`: its training count."""

    def __init__(self, number: int, names: Names, many: np.ndarray, u: np.ndarray, c: np.ndarray):
        self.names, self.words = names, len(many)
        self.w, self.u, self.c = np.repeat(np.arange(len(many)), many), u.astype(np.int64), c.astype(np.float64)
        self.total = np.bincount(self.w, weights=self.c, minlength=self.words)
        self.own = self.u < names.n  # the others sit in the restaurants of their classes
        q, self.q = np.unique(self.w * (CLASSES + 1) + names.classes(self.u), return_inverse=True)
        self.qw, self.qk = q // (CLASSES + 1), q % (CLASSES + 1)
        self.c1 = np.where(self.own, self.c, 0.0)
        self.t1 = np.minimum(self.c1, 1.0)
        self._second()
        self.t2 = np.minimum(self.c2, 1.0)
        self._parent()
        self.t0 = np.minimum(self.c0, 1.0)
        self.rng = np.random.default_rng(number + 1)

    def _second(self) -> None:
        self.c2 = np.bincount(self.q, weights=np.where(self.own, self.t1, self.c), minlength=len(self.qw))

    def _parent(self) -> None:
        self.c0 = np.bincount(self.qw, weights=self.t2, minlength=self.words)

    def sums(self) -> np.ndarray:
        """Customers and tables of each word's restaurant and of each class's, then tables of the parent, tokens, customers of all, and counts of one and two by level."""
        n, k = self.names.n, CLASSES + 1
        per = lambda at, x, size: np.bincount(at, weights=x, minlength=size)[:size]
        u = np.where(self.own, self.u, n)
        ones = [float((c == j).sum()) for c in (self.c1, self.c2, self.c0) for j in (1, 2)]
        return np.r_[per(u, self.c1, n + 1)[:n], per(u, self.t1, n + 1)[:n], per(self.qk, self.c2, k), per(self.qk, self.t2, k), self.t0.sum(), (self.total > 0).sum(), self.c.sum(), ones]

    def parent(self, s: Sums) -> np.ndarray:
        return (np.maximum(self.c0 - s.d0 * self.t0, 0) + (STRENGTH + s.d0 * s.t0) / (s.v + 1)) / (STRENGTH + s.t2.sum())

    def second(self, s: Sums, base: np.ndarray) -> np.ndarray:
        return (np.maximum(self.c2 - s.d2 * self.t2, 0) + (STRENGTH + s.d2 * s.t2[self.qk]) * base[self.qw]) / (STRENGTH + s.c2[self.qk])

    def predictive(self, s: Sums) -> np.ndarray:
        """The probability of each pair's token after its context."""
        out = self.second(s, self.parent(s))[self.q]
        k, u = np.flatnonzero(self.own), self.u[self.own]
        out[k] = (np.maximum(self.c1[k] - s.d1 * self.t1[k], 0) + (STRENGTH + s.d1 * s.t1[u]) * out[k]) / (STRENGTH + s.c1[u])
        return out

    def sweep(self, s: Sums) -> None:
        base = self.parent(s)
        k, u = np.flatnonzero(self.own & (self.c1 > 0)), self.u[self.own & (self.c1 > 0)]
        self.t1[k] = _seat(self.c1[k], (STRENGTH + s.d1 * s.t1[u]) * self.second(s, base)[self.q[k]], s.d1, self.rng)
        self._second()
        self.t2 = _seat(self.c2, (STRENGTH + s.d2 * s.t2[self.qk]) * base[self.qw], s.d2, self.rng)
        self._parent()
        self.t0 = _seat(self.c0, np.full(self.words, (STRENGTH + s.d0 * s.t0) / (s.v + 1)), s.d0, self.rng)


class Sums:
    """Sums over all buckets."""

    def __init__(self, x: np.ndarray, n: int):
        k = CLASSES + 1
        self.c1, self.t1, self.c2, self.t2 = np.split(x[: 2 * n + 2 * k], [n, 2 * n, 2 * n + k])
        self.t0, self.v, self.n, *ones = x[2 * n + 2 * k :]
        self.d1, self.d2, self.d0 = (min(0.95, max(0.05, one / max(one + 2 * two, 1))) for one, two in zip(ones[::2], ones[1::2]))


# ---- the job --------------------------------------------------------------------------------

_STATE = "bucket int, words binary, many binary, u binary, c binary, steps array<long>, toks array<int>, pairs array<int>, step_tok binary, step_many binary, step_u binary"


def _merge(part: pa.Table) -> pa.Table:
    """A bucket's state: its distinct tokens, pairs and counts, and the steps' own lists one after the other, without counts."""
    parts = {k: [x.as_py() for x in part[k]] for k in ("tok", "many", "u", "c")}
    tok, many = np.frombuffer(b"".join(parts["tok"]), _U), np.frombuffer(b"".join(parts["many"]), np.uint32)
    u, c = np.frombuffer(b"".join(parts["u"]), np.uint16), np.frombuffer(b"".join(parts["c"]), np.uint32)
    words, place = np.unique(tok, return_inverse=True)
    pair, at = np.unique((np.repeat(place, many).astype(_U) << _U(16)) | u, return_inverse=True)
    # counts are whole numbers far below 2 ** 53, so sums of doubles are exact
    count = np.bincount(at, weights=c, minlength=len(pair)).astype(np.int64)
    per = np.bincount((pair >> _U(16)).astype(np.int64), minlength=len(words)).astype(np.uint32)
    toks, pairs = [len(x) // 8 for x in parts["tok"]], [len(x) // 2 for x in parts["u"]]
    cell = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.table([part["bucket"].slice(0, 1), cell(words), cell(per), cell((pair & _U(0xFFFF)).astype(np.uint16)), cell(count), pa.array([part["step"].to_pylist()], pa.list_(pa.int64())), pa.array([toks], pa.list_(pa.int32())), pa.array([pairs], pa.list_(pa.int32())), cell(tok), cell(many), cell(u)], names=[f.split()[0] for f in _STATE.split(", ")])


def _read(batch: pa.RecordBatch, k: int, names: Names) -> Bucket:
    number, many, u, c = (batch.column(x)[k].as_py() for x in ("bucket", "many", "u", "c"))
    return Bucket(number, names, np.frombuffer(many, np.uint32), np.frombuffer(u, np.uint16), np.frombuffer(c, np.int64))


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of the tables `x` by `keys`."""

    def add(part: pa.Table) -> pa.Table:
        x = np.zeros(len(part["x"][0].as_py()) // 8)
        for cell in part["x"]:
            x += np.frombuffer(cell.as_py())
        return pa.table({**{k: part[k].slice(0, 1) for k in keys}, "x": pa.array([x.tobytes()], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(add, "".join(f"{k} int, " for k in keys) + "x binary")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    tables = Tables(spark, "lm")
    found = frequent(docs)
    names = spark.sparkContext.broadcast(found)
    state = tables.write(_entries(docs, names, exchange.buckets_for(docs)).groupBy("bucket").applyInArrow(_merge, _STATE), "state")
    history: list[Sums] = []

    def gather(known):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(0)
            for batch in batches:
                for k in range(batch.num_rows):
                    bucket = _read(batch, k, names.value)
                    for s in known.value:
                        bucket.sweep(s)
                    x = bucket.sums()
                    total = x if not len(total) else total + x
            if len(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array(np.full(CHUNKS, TaskContext.get().partitionId() // TASKS, np.int32)), pa.array([x.tobytes() for x in np.array_split(total, CHUNKS)], pa.binary())], names=["chunk", "part", "x"])

        return run

    for _ in range(SWEEPS):
        known = spark.sparkContext.broadcast(list(history))
        rows = state.select("bucket", "many", "u", "c").mapInArrow(gather(known), "chunk int, part int, x binary")
        parts = _added(_added(rows, "chunk", "part"), "chunk").collect()
        x = np.concatenate([np.frombuffer(r["x"]) for r in sorted(parts)]) if parts else np.zeros(2 * found.n + 2 * (CLASSES + 1) + 9)
        history.append(Sums(x, found.n))
    sums = spark.sparkContext.broadcast(history)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bucket = _read(batch, k, names.value)
                p = np.zeros(len(bucket.c))
                for i, s in enumerate(sums.value):  # the sums of the very state they are used with, so that probabilities sum to one
                    if i:
                        bucket.sweep(sums.value[i - 1])
                    if i >= BURN:
                        p += bucket.predictive(s)
                log = np.rint(np.maximum(np.log10(p / (len(sums.value) - BURN)) / -GRAIN, 0)).astype(np.uint32)
                words, tok, many, u = (np.frombuffer(batch.column(x)[k].as_py(), t) for x, t in (("words", _U), ("step_tok", _U), ("step_many", np.uint32), ("step_u", np.uint16)))
                place = np.searchsorted(words, tok)
                pair = (bucket.w.astype(_U) << _U(16)) | bucket.u.astype(_U)
                at = np.searchsorted(pair, (np.repeat(place, many).astype(_U) << _U(16)) | u)
                steps, toks, pairs = (batch.column(x)[k].as_py() for x in ("steps", "toks", "pairs"))
                cut_t, cut_p = np.r_[0, np.cumsum(toks)], np.r_[0, np.cumsum(pairs)]
                checks = [_check(tok[a:b]) for a, b in zip(cut_t, cut_t[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), pa.array(np.full(len(steps), batch.column("bucket")[k].as_py(), np.int32)), exchange.blob(log[at], cut_p), exchange.blob(many, cut_t), exchange.blob(bucket.total[place].astype(np.int64), cut_t), pa.array(checks)], names=["step", "bucket", "log", "many", "count", "check"])

    answers = state.mapInArrow(answer, "step long, bucket int, log binary, many binary, count binary, check long")
    doc_type = docs.schema["doc_id"].dataType
    fields = [("held_out", T.BooleanType()), *((c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *((c, T.DoubleType()) for c in ("base_score", "score", "perplexity"))]

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        s = sums.value[0]
        if left.num_rows != 1:
            raise ValueError("the texts were dealt otherwise in the second pass: store the table first")
        right = right.sort_by("bucket")
        log, many, count = (exchange.joined(right[x], t) for x, t in (("log", np.uint32), ("many", np.uint32), ("count", np.int64)))
        checks = np.uint64(sum(x & (2**64 - 1) for x in right["check"].to_pylist()) % 2**64).astype(np.int64)
        if len(log) != left["pairs"][0].as_py() or checks != left["check"][0].as_py():
            raise ValueError("the texts were dealt otherwise in the second pass: store the table first")
        code = np.frombuffer(zstandard.ZstdDecompressor().decompress(left["codes"][0].as_py()), np.int32)
        sizes = left["sizes"].combine_chunks().flatten().to_numpy()
        row, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        base = np.repeat(np.log10((count + 0.1) / (s.n + 0.1 * (s.v + 1))), many)
        known = np.repeat(count > 0, many)
        add_up = lambda x: np.bincount(row, weights=x[code], minlength=n)
        total = add_up(log.astype(np.int64)) * -GRAIN
        return pa.table([left["ids"].combine_chunks().flatten(), left["held"].combine_chunks().flatten(), pa.array(sizes.astype(np.int64)), pa.array(add_up(known).astype(np.int64)), pa.array(np.full(n, int(s.n))), pa.array(add_up(base)), pa.array(total), pa.array(10.0 ** np.minimum(300, -total / sizes))], names=["doc_id", *(f for f, _ in fields)])

    return _codes(docs, names).groupBy("step").cogroup(answers.groupBy("step")).applyInArrow(add, T.StructType([T.StructField("doc_id", doc_type), *(T.StructField(*f) for f in fields)]))
