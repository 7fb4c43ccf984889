"""The manifest against a plain recursion over lists."""

import hashlib
import random
import zlib

import pytest

from plurivox.llm import merkle

from . import fixtures


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    text = row["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join(enc(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def grown(nodes):
    """All levels of a tree, the given one first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 16
        out.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return out


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    top = grown([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        above = path_of(top, k)
        for at, (_, _, leaf, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = path_of(trees[s], at) + above
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            folded = leaf_of(r, True) if hit else leaf
            for left, right in path:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join(d for left, right in path for d in (*left, *right)))
            out.append((str(r["doc_id"]), leaf, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


def test_awkward_rows_equal_recursion(spark):
    docs = fixtures.awkward(spark)
    assert got(merkle.manifest(docs)) == brute(docs.collect())


def test_large_group_over_several_blocks(spark):
    rng = random.Random(4)
    rows = [(k, "Text " + "Ab" * rng.randint(0, 3), "en", "hot" if k % 3 else f"s{k % 40}", k) for k in range(6500)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert got(merkle.manifest(docs)) == brute(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_around_the_fanout(spark, n):
    docs = spark.createDataFrame([(k, f"T{k}", None, None, 1) for k in range(n)], "doc_id int, text string, lang string, source string, n_chars long")
    assert got(merkle.manifest(docs)) == brute(docs.collect())


def test_many_groups(spark):
    docs = spark.createDataFrame([(k, "x", "en", f"é{k}", 1) for k in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(merkle.manifest(docs)) == brute(docs.collect())


def test_empty(spark):
    assert merkle.manifest(fixtures.empty(spark)).collect() == []
