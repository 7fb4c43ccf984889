"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of non-space characters, and every token of a text is decoded. States: outside, begin, inside; inside
never follows outside. The features of a token are its kinds of characters, length, changes of kind, beginning and
end, separators, vowels and key words in it, the words, kinds and key words next to it, and file features (share of
tokens with a digit, of tokens with `=` or `:`). All features of a step of texts are numpy columns. Tokens that
are outside in every best path (by a bound on what any other state could gain) cut the text; Viterbi runs over the
stretches between them, so the path is the best of the whole text.

Training. A bounded sample of documents (`SAMPLE`, those of the smallest hashed ids) gives windows of tokens. The fixed patterns' own values
are labelled in them; as those alone would teach the field to repeat the patterns, `PLANTED` made-up secrets of many shapes are put
into each sampled text, with and without key words of many kinds, so that values are known by their looks or by
what stands before them. Unlabelled tokens that look like secrets themselves, by letters and digits in one long token or after a key word,
are in doubt and no examples; all other tokens are outside. A window holds `WINDOW` tokens on either side of a value, of a
token with a digit or separator, or of any token. Made-up secrets are more frequent than real ones, so `CAUTION` is taken off the
scores of begin and inside.

A span of the field begins after the last `=` or `:` that a key word in its first token leads to, and loses quotes and brackets
at its ends; spans that meet a base span are dropped, for base spans stay as they are.

Defined cases: a null or empty text has no spans; a null doc_id and repeated rows give one result row per input
row; other columns are ignored; an empty table trains an empty model and returns no rows. Of a token's beginning the first four
bytes, of its length the first 63 bytes count as features; everything else covers the whole token.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Documents that training reads at most, windows of each, and windows in all.
SAMPLE, PER_DOCUMENT, MOST_WINDOWS = 2000, 10, 16_000
#: Made-up secrets in each sampled text.
PLANTED = 3
FEATURES = 1 << 16
#: Tokens of the training windows that a feature needs; rarer ones would learn single texts by heart, unknown secrets in them included.
SEEN = 25
EPOCHS = 12
BATCH = 512
WINDOW = 10
CAUTION = 2.0
KINDS = ("assign", "access", "hex", "crf")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same matches as [0-9a-f]+ of 24 characters or more

_KEYS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer", "private", "login", "pin")
_KEY = re.compile("|".join(_KEYS).encode())
_LEAD = re.compile(r"""["'(\[{]*[A-Za-z_.-]*(?i:%s)[A-Za-z_-]*["']?[:=]+["']?""" % "|".join(_KEYS))
_EDGE = "\"'`,;()[]{}<>.!?"
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def base_matches(text: str) -> list[tuple[str, int, int, int]]:
    """kind, start, end and start of the value of each base span."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [s[:3] for s in base_matches(text)]


# ---- features -------------------------------------------------------------------------------

_CLASS = np.full(256, 4, np.uint8)  # 1 digits, 2 capitals, 3 small letters, 4 other ASCII, 5 beyond ASCII
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 5
_MARKS = b"=:_-/+.@"
_VOWEL, _HEXES = np.zeros(256, bool), np.zeros(256, bool)
_VOWEL[[*b"aeiouyAEIOUY"]] = True
_HEXES[[*b"0123456789abcdefABCDEF"]] = True
#: Number of features of a token.
WIDTH = 20


def features(words: shared.Words) -> np.ndarray:
    """Feature numbers, one column a feature, of all tokens of `words` (whose letters keep their case)."""
    buf, starts, ends, n = words.buf, words.starts, words.ends, len(words.starts)
    out = np.zeros((n, WIDTH), np.uint16)
    if not n:
        return out
    lens = ends - starts
    cls = _CLASS[buf]

    def count(flags: np.ndarray) -> np.ndarray:
        c = np.r_[np.int32(0), np.cumsum(flags, dtype=np.int32)]
        return c[ends] - c[starts]

    per = [count(cls == k) for k in (1, 2, 3, 4, 5)]
    kinds = sum((c > 0).astype(np.int64) << k for k, c in enumerate(per))
    size = np.minimum(lens, 63) // 4
    c = np.r_[np.int32(0), np.cumsum(cls[1:] != cls[:-1], dtype=np.int32)]
    turns = np.minimum(c[ends - 1] - c[starts], 15)
    letters = np.maximum(per[1] + per[2], 1)
    vowels = np.minimum(count(_VOWEL[buf]) * 8 // letters, 7)
    marks = sum((count(buf == m) > 0).astype(np.int64) << k for k, m in enumerate(_MARKS))
    low = shared._LOWER[buf]
    key = np.zeros(n, np.int64)
    found = [(m.start(), _KEYS.index(m[0].decode()) + 1) for m in _KEY.finditer(low.tobytes())]
    if found:
        at = np.searchsorted(starts, [p for p, _ in found], side="right") - 1
        key[at] = [k for _, k in found]
    word = shared.hash_spans(low, starts, ends).astype(np.int64)
    beginning = np.zeros(n, np.int64)
    for j in range(4):
        beginning = beginning * 256 + np.where(lens > j, buf[np.minimum(starts + j, len(buf) - 1)], 0)
    last, looks = buf[ends - 1].astype(np.int64), kinds * 16 + size
    hexes = count(_HEXES[buf]) == lens
    doc, first = words.doc, words.first
    rows = np.maximum(np.diff(first), 1)
    share = lambda flags: np.minimum(np.bincount(doc, weights=flags, minlength=len(rows)) * 20 // rows, 19).astype(np.int64)[doc]

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        """`x` of the token `by` places on, -1 beyond the row's ends."""
        out = np.full(n, -1, np.int64)
        if by < 0:
            out[-by:] = np.where(doc[-by:] == doc[:by], x[:by], -1)
        else:
            out[:-by] = np.where(doc[:-by] == doc[by:], x[by:], -1)
        return out

    values = [
        np.zeros(n, np.int64), looks, turns * 16 + size, (per[0] * 8 // lens) * 16 + size, beginning, last * 32 + kinds, key, marks, hexes * 16 + size, vowels * 512 + looks,
        shifted(word, -1), shifted(key, -1), shifted(last, -1), shifted(looks, -1), shifted(key, -2) * 256 + shifted(last, -1), shifted(word, -2), shifted(looks, 1),
        share(per[0] > 0), share((marks & 3) > 0), (turns * 8 + vowels) * 4 + (shifted(key, -1) > 0) * 2 + (shifted(key, -2) > 0),
    ]
    for k, v in enumerate(values):
        out[:, k] = shared.mix(v.astype(np.uint64) * np.uint64(64) + np.uint64(k)) & np.uint64(FEATURES - 1)
    return out


# ---- the field ------------------------------------------------------------------------------


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Model:
    """Weights of the features (states outside, begin, inside) and of the transitions."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, 3))
        self.w[:, 1:] = -0.2
        self.t = np.array([[0.0, 0.0, -1e9], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])

    def scores(self, feats: np.ndarray) -> np.ndarray:
        e = np.zeros((len(feats), 3))
        for k in range(feats.shape[1]):
            e += self.w[feats[:, k]]
        e[:, 1:] -= CAUTION
        return e

    def viterbi(self, e: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> list[int]:
        """The best states; `first` and `last` weigh what stands before and after them. Without `first` no path begins inside."""
        t, back, scores = self.t.tolist(), [], e.tolist()
        best = [x + y for x, y in zip(scores[0], (0.0, 0.0, -1e9) if first is None else first.tolist())]
        for x in scores[1:]:
            now, frm = [], []
            for s in (0, 1, 2):
                c = max((0, 1, 2), key=lambda p: best[p] + t[p][s])
                frm.append(c)
                now.append(best[c] + t[c][s] + x[s])
            best = now
            back.append(frm)
        if last is not None:
            best = [x + y for x, y in zip(best, last.tolist())]
        path = [max((0, 1, 2), key=best.__getitem__)]
        for frm in reversed(back):
            path.append(frm[path[-1]])
        return path[::-1]

    def decode(self, words: shared.Words) -> np.ndarray:
        """The best states of all tokens of all rows, each row decoded by itself."""
        n, t = len(words.starts), self.t
        path = np.zeros(n, np.int8)
        if not n:
            return path
        e = self.scores(features(words))
        # the most that a stretch of begin and inside gains over outside, for the best stretch that holds each token;
        # stretches may pass the ends of rows here, which only makes the bound wider
        enter, leave = max(0.0, t[0, 1] - t[0, 0]), max(0.0, t[1, 0] - t[0, 0], t[2, 0] - t[0, 0])
        stay = t[1:, 1:].max() - t[0, 0]
        total = np.r_[0.0, np.cumsum(e[:, 1:].max(axis=1) - e[:, 0] + stay)]
        most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        open_ = most - stay + enter + leave + abs(t[0, 0]) >= -1e-6
        at = np.flatnonzero(open_)
        if not len(at):
            return path
        cut = np.flatnonzero((np.diff(at) > 1) | (words.doc[at[1:]] != words.doc[at[:-1]])) + 1
        for part in np.split(at, cut):
            a, b, row = int(part[0]), int(part[-1]) + 1, words.doc[part[0]]
            path[a:b] = self.viterbi(e[a:b], t[0] if a > words.first[row] else None, t[:, 0] if b < words.first[row + 1] else None)
        return path

    def fit(self, feats: np.ndarray, gold: np.ndarray, size: np.ndarray, rate: float = 0.25) -> Model:
        """Adaptive gradient ascent on the conditional likelihood of windows (feats: window, token, feature), forward-backward for the expectations."""
        often = np.bincount(feats[np.arange(feats.shape[1]) < size[:, None]].ravel(), minlength=FEATURES) >= SEEN
        self.w[~often] = 0.0
        order, g2, t2 = np.random.default_rng(7), np.full(self.w.shape, 1e-6), np.full((3, 3), 1e-6)
        for _ in range(EPOCHS):
            for part in np.array_split(order.permutation(len(size)), max(1, len(size) // BATCH)):
                longest = int(size[part].max())
                x, y, n = feats[part, :longest], gold[part, :longest], size[part]
                e = self.w[x].sum(axis=2)
                live = np.arange(longest) < n[:, None]
                fwd, bwd = np.zeros_like(e), np.zeros_like(e)
                fwd[:, 0] = e[:, 0] + (0.0, 0.0, -1e9)
                for j in range(1, longest):
                    step = e[:, j] + _logsum(fwd[:, j - 1, :, None] + self.t, 1)
                    fwd[:, j] = np.where(live[:, j, None], step, fwd[:, j - 1])
                for j in range(longest - 2, -1, -1):
                    step = _logsum(self.t + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
                    bwd[:, j] = np.where(live[:, j + 1, None], step, 0.0)
                z = _logsum(fwd[:, -1], 1)
                p = np.exp(fwd + bwd - z[:, None, None])
                g = (np.eye(3)[y] - p) * live[:, :, None]
                flat = x[live].ravel()
                grad = np.stack([np.bincount(flat, weights=np.repeat(g[live][:, s], x.shape[2]), minlength=FEATURES) for s in range(3)], axis=1) / len(part)
                grad = (grad - 1e-5 * self.w) * often[:, None]
                g2 += grad * grad
                self.w += rate * grad / np.sqrt(g2)
                if longest > 1:
                    pair = np.exp(fwd[:, :-1, :, None] + self.t + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
                    seen = np.zeros((3, 3))
                    np.add.at(seen, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1.0)
                    tg = (seen - pair.sum(axis=(0, 1))) / len(part)
                    tg[0, 2] = 0.0
                    t2 += tg * tg
                    self.t += rate * tg / np.sqrt(t2)
        return self


# ---- training windows -----------------------------------------------------------------------

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LEADS = ("password", "passwd", "pwd", "passphrase", "secret", "client_secret", "token", "access-token", "api_key", "apikey", "private_key", "auth", "authorization", "credential", "credentials", "Bearer", "login", "pin code", "key")
_HEADS = ("", "", "", "ghp_", "sk-", "xoxb-", "eyJ", "pk_live_", "glpat-", "AIza")


def made_up(rng: random.Random) -> tuple[str, str]:
    """The lead and the value of a made-up secret."""
    draw = lambda letters, least, most: "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
    value = rng.choice([
        lambda: rng.choice(_HEADS) + draw(_ALNUM, 16, 40),
        lambda: draw("0123456789abcdef", 16, 64),
        lambda: draw("0123456789ABCDEF", 16, 40),
        lambda: draw(_ALNUM + "+/", 20, 60) + rng.choice(["", "=", "=="]),
        lambda: draw(_ALNUM + "!#$%&*-_", 8, 24),
        lambda: "-".join(draw("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: draw("bcdfghjklmnpqrstvwxz", 9, 16),
    ])()
    if len(value) >= 20 and any(c.isdigit() for c in value) and rng.random() < 0.35:
        return "", value  # known by its looks alone
    lead = rng.choice(_LEADS)
    lead = lead.upper() if rng.random() < 0.2 else lead
    quote = rng.choice(["", "", '"'])
    return lead + rng.choice([": ", "=", " = ", " is ", " ", " := ", ":"]) + quote, value + quote


#: Unlabelled tokens that look like secrets by themselves, or after a key word.
_DOUBT = re.compile(rb"""["'(]*(?=[^\s]*[0-9])(?=[^\s]*[A-Za-z])[A-Za-z0-9+_=!#$%&*-]{6,}["').,;]*$""")


def windows(text: str, rng: random.Random) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and states of the training windows of a text, with made-up secrets in it."""
    places = sorted(rng.choice([m.end() for m in re.finditer(r"\S+", text)] or [0]) for _ in range(PLANTED))
    parts, marked, at, size = [], [], 0, 0
    for place in places:
        lead, value = made_up(rng)
        piece = text[at:place] + " " + lead
        marked.append((size + len(piece), size + len(piece) + len(value)))
        piece += value
        parts.append(piece)
        at, size = place, size + len(piece)
    text = "".join(parts) + text[at:]
    marked += [(value, end) for _, _, end, value in base_matches(text)]
    words = shared.Words(pa.array([text], pa.string()), lower=False)
    n = len(words.starts)
    byte = lambda k: len(text[:k].encode())
    gold, wanted = np.zeros(n, np.int8), []
    for a, b in sorted(marked):
        i, j = np.searchsorted(words.ends, byte(a), side="right"), np.searchsorted(words.starts, byte(b))
        if j > i and not gold[i:j].any():
            gold[i], gold[i + 1 : j] = 1, 2
            wanted.append(int(i))
    feats = features(words)
    tokens = [words.buf[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
    keys = [bool(_KEY.search(t.lower())) for t in tokens]
    doubt = np.array([not gold[k] and bool(_DOUBT.match(t) and (len(t) >= 16 or any(keys[max(0, k - 2) : k]))) for k, t in enumerate(tokens)])
    odd = [k for k in range(n) if not gold[k] and re.search(rb"[0-9=:_]", tokens[k])]
    wanted = wanted[: PER_DOCUMENT // 2] if len(wanted) <= PER_DOCUMENT // 2 else rng.sample(wanted, PER_DOCUMENT // 2)
    wanted += rng.sample(odd, min(len(odd), PER_DOCUMENT // 4)) + [rng.randrange(n) for _ in range(PER_DOCUMENT // 4)]
    for k in wanted:
        if doubt[k]:
            continue
        a, b = max(0, k - WINDOW), min(n, k + WINDOW + 1)
        # tokens in doubt end a window
        for j in np.flatnonzero(doubt[a:b]) + a:
            a, b = (j + 1, b) if j < k else (a, min(b, j))
        yield feats[a:b], gold[a:b]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(ids), "doc_id", "left_semi").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches):
            found = [w for t in step.column(1).to_pylist() if t.strip() for w in windows(t, random.Random(zlib.crc32(t.encode())))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([g.tobytes() for _, g in found], pa.binary())], names=["f", "g"])

    found = rows.mapInArrow(run, "f binary, g binary").orderBy(F.xxhash64("f"), "f", "g").limit(MOST_WINDOWS).toArrow()
    if not found.num_rows:
        return Model()
    size = np.array([len(g) for g in found["g"].to_pylist()])
    feats, gold = np.zeros((len(size), 2 * WINDOW + 1, WIDTH), np.uint16), np.zeros((len(size), 2 * WINDOW + 1), np.int64)
    for k, (f, g) in enumerate(zip(found["f"].to_pylist(), found["g"].to_pylist())):
        feats[k, : size[k]] = np.frombuffer(f, np.uint16).reshape(-1, WIDTH)
        gold[k, : size[k]] = np.frombuffer(g, np.int8)
    return Model().fit(feats, gold, size)


# ---- scan -----------------------------------------------------------------------------------


def field_spans(model: Model, texts: pa.Array) -> list[list[tuple[int, int]]]:
    """The field's spans of each text, in code points."""
    words = shared.Words(texts, lower=False)
    path = model.decode(words)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    begins = np.flatnonzero(path == 1)
    if not len(begins):
        return out
    rest = np.flatnonzero(path != 2)
    stops = np.r_[rest, len(path)][np.searchsorted(rest, begins, side="right")]
    for a, b in zip(begins.tolist(), stops.tolist()):
        row = int(words.doc[a])
        b = min(b, int(words.first[row + 1]))
        base, start, end = int(words.offsets[row]), int(words.starts[a]), int(words.ends[b - 1])
        piece = words.buf[start:end].tobytes().decode()
        at = int(np.count_nonzero((words.buf[base:start] & 0xC0) != 0x80))
        lead = _LEAD.match(piece)
        lo, hi = lead.end() if lead else 0, len(piece)
        while lo < hi and piece[lo] in _EDGE:
            lo += 1
        while hi > lo and piece[hi - 1] in _EDGE:
            hi -= 1
        if hi > lo:
            out[row].append((at + lo, at + hi))
    return out


def merged(base: list[tuple[str, int, int]], field: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and the field's spans that meet none of them; both lists are sorted."""
    more, k, reach = [], 0, 0
    for a, b in field:
        while k < len(base) and base[k][1] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a:
            more.append(("crf", a, b))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def step_spans(model: Model, texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """All spans of each text."""
    return [merged(base_spans(t) if t else [], f) for t, f in zip(texts.to_pylist(), field_spans(model, texts))]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>: code points, end exclusive, by start and then kind."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for step in shared.steps(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in step_spans(held.value, step.column(1))]
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("spans", SPAN)]))


def cleaned(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    parts, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            parts += [text[at:a], mark]
        at = b
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", model: Model | None = None) -> DataFrame:
    """`docs` with every span of the text replaced by `mark` (spans that overlap by one), and n_chars, where there, counted anew."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches, text=place):
            texts = step.column(place)
            new = [cleaned(t, s, mark) if s else t for t, s in zip(texts.to_pylist(), step_spans(held.value, texts))]
            yield step.set_column(place, step.schema.field(place), pa.array(new, texts.type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of op1."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )
