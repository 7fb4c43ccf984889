"""BPE encoding and decoding with a public vocabulary file, by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks up every adjacent pair by binary search
over the sorted pair keys, takes each word's lowest rank, merges all its pairs of that rank from left to right and
packs the array again; words without a known pair leave. Each Arrow batch encodes each of its distinct words
once; documents are gathered from the words' ids.

The text steps of the file (special tokens in the raw text, NFC, white space runs, lower case, split pattern,
byte-level alphabet, word end) are kept as the tokenizers library does them; its decode without a decoder joins the
tokens by one space.

Characters that Unicode has had only since version 15.1 can be split otherwise, as libraries' tables differ.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null doc_id and repeated rows give
one result row per input row; other columns are ignored.
"""

from __future__ import annotations

import importlib
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared

#: Distinct words that a task remembers between batches; a full memory starts anew.
REMEMBERED = 200_000
NONE = np.int64(1) << 40


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)


def _byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in kept else extra))
        extra += b not in kept
    return out


class Vocabulary:
    """A vocabulary file of the kind `BPE with word ends`."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(max([*ids.values(), *self.special.values()]) + 1, dtype=object)
        for t, i in {**ids, **self.special}.items():
            self.tokens[i] = t
        alphabet = _byte_alphabet()
        self.byte_id = np.array([ids[c] for c in alphabet], dtype=np.int64)
        self.byte_end_id = np.array([ids[c + self.end] for c in alphabet], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = np.array([ids[a] for a, _ in merges]), np.array([ids[b] for _, b in merges])
        keys = (left << 20) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.into = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.space = regex.compile(r"\p{White_Space}+")

    def words(self, text: str) -> list[str]:
        """Pieces of a text: special tokens as they are, words after a mark that no special token bears."""
        out: list[str] = []
        at = 0
        if self.specials and "<|" in text:
            for m in self.specials.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(m[0])
                at = m.end()
        return out + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers each character by itself
                text = text.replace("Σ", "σ")
        return ["\0" + w for w in self.split.findall(self.space.sub(" ", text).lower())]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the n + 1 offsets of the pieces."""
        raw = [w[1:].encode("utf-8") if w[:1] == "\0" else b"" for w in words]
        lens = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(lens)
        sym = self.byte_id[flat]
        full = lens > 0
        sym[ends[full] - 1] = self.byte_end_id[flat[ends[full] - 1]]
        owner = np.repeat(np.arange(len(words)), lens)
        done_sym, done_owner = [], []
        while len(sym):
            rank = self._ranks(sym, owner)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            each = np.repeat(best, size)
            over = each == NONE
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                sym, owner, rank, each = sym[~over], owner[~over], rank[~over], each[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == each)
            # pairs of one rank that overlap (x x x): every second of a chain, from the left
            chain = np.r_[0, np.cumsum(np.diff(hit) != 1)]
            start = np.searchsorted(chain, chain)
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            sym = sym.copy()
            sym[hit] = self.into[each[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, owner = sym[keep], owner[keep]
        named = [(k, self.special[w]) for k, w in enumerate(words) if w[:1] != "\0"]
        if named:
            done_sym.append(np.array([i for _, i in named]))
            done_owner.append(np.array([k for k, _ in named]))
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]

    def _ranks(self, sym: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each symbol, NONE where there is none."""
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            pair = (sym[:-1] << 20) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            ok = (self.keys[at] == pair) & (owner[1:] == owner[:-1])
            rank[:-1][ok] = self.rank[at[ok]]
        return rank

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.tokens[ids])


class _Memory:
    """Distinct words met so far and their ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > REMEMBERED:
            self.clear()
        index = self.index
        pieces = [self.v.words(t) for t in texts]
        new: list[str] = []
        coded = []
        for ws in pieces:
            try:
                coded.append([index[w] for w in ws])
            except KeyError:
                for w in ws:
                    if w not in index:
                        index[w] = len(index)
                        new.append(w)
                coded.append([index[w] for w in ws])
        if new:
            ids, offsets = self.v.encode_words(new)
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
        out = []
        for c in coded:
            k = np.array(c, dtype=np.int64)
            at, size = self.offsets[k], self.offsets[k + 1] - self.offsets[k]
            total = np.cumsum(size)
            out.append(self.ids[np.arange(total[-1] if len(k) else 0) + np.repeat(at - (total - size), size)])
        return out


def _encoded(docs: DataFrame, path: str | None, columns: list, pack) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or vocabulary_path()))
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(held.value)
        for batch in shared.steps(batches):
            ids = memory.encode([t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *pack(held.value, ids)], names=["doc_id", *(c.name for c in columns)])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *columns]))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the tokens of each text."""
    return _encoded(docs, path, [T.StructField("ids", T.ArrayType(T.IntegerType()))], lambda v, ids: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the tokens of `ids` joined by one space."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path or vocabulary_path()))
    rows = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [held.value.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest columns of op9, from the ids and from their decoding."""
    columns = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _encoded(docs, path, columns, lambda v, ids: [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([shared.sha(x.astype("<u4").tobytes()) for x in ids], pa.string()),
        pa.array([shared.sha(v.decode(x).encode("utf-8")) for x in ids], pa.string()),
    ])
