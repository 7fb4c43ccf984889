import hashlib
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plurivox.llm import bpe

from . import fixtures

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=60))
def test_any_text(library, vocabulary, text):
    ids = bpe._Memory(vocabulary).encode([text])[0]
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert vocabulary.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_special_tokens_and_repeats(library, vocabulary):
    for text in ("a<|endoftext|>b", "<|startoftext|><|endoftext|>", "aaaaaaa aaaa aa", "'S don't WE'LL", "İΣΣ ς", "é", "x" * 5000):
        assert bpe._Memory(vocabulary).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_table(spark, library):
    docs = fixtures.awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    got = sorted(bpe.round_trip(docs).collect(), key=lambda r: (str(r[0]), r[2]))
    want = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (str(r[0]), r[2]))
    assert bpe.round_trip(fixtures.empty(spark)).count() == 0


def test_encode_decode(spark, library):
    docs = fixtures.table(spark, ["Some words", "", None])
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {0: library.decode(library.encode("Some words", add_special_tokens=False).ids, skip_special_tokens=False), 1: "", 2: ""}


def test_no_vocabulary_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for _, _, names in os.walk(os.path.join(root, "plurivox")) for f in names if f.endswith((".json", ".model", ".tiktoken"))]
