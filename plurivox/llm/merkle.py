"""Merkle manifest of a table: a digest tree per group (source), one tree over the groups, and a proof for each row.

A row's leaf is the hash of its columns, made in the JVM. Leaves are sorted by group and id over range partitions; a row's
place in its group is its place in its partition plus the rows of the group in earlier partitions, so that no task
holds a group. The trees are then built in aligned blocks of `BLOCK` neighbours: a block's digests are one contiguous
numpy matrix of 64 hex bytes a row, `FANOUT` rows reshaped to one are hashed level by level, and the block sends its
last digest up. What a round leaves is `BLOCK` times smaller and goes through the same step until each group has
one node; the groups' nodes, ordered by group, form the last tree. On the way down each block gets the siblings
above it as one row, and reads the siblings inside it from the matrices by index arithmetic.

Hashes are lower-case hex SHA-256 of the inputs put together, digests as hex text. While a tree has several nodes, each
run of `FANOUT` consecutive ones (the last run may have fewer, even one) becomes their hash.

Defined cases: null columns count as `-`; a null id stands before all others of its group and is never tampered with; rows of one id
stand in the order of their leaves, and each has its own place; a null group is a group and stands first; an empty
table has no rows and no root; texts of any length are hashed in the JVM and never shuffled; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Tables, lower_ascii, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Levels of one aligned block.
DEPTH = 3
BLOCK = FANOUT**DEPTH
HEX = 64
#: Rows after which a task hands on what it has.
FLUSH = 8192

_PATH = "array<struct<l: string, r: string>>"
_OUT = "doc_id {id}, leaf string, subroot string, proof_sha256 string, folded_root string"


def _hex(data: bytes | np.ndarray) -> str:
    return hashlib.sha256(data).hexdigest()


def field(value: Column) -> Column:
    """A value as the leaf takes it in: its bytes with their count before them, `-` if null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source), digest, tampered (the leaf with a lower-case text, where the id calls for tampering)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", F.col("source").cast("string").alias("tree"), leaf(F.col("text")).alias("digest"), F.when(hit, leaf(lower_ascii(F.col("text")))).alias("tampered"))


def height(n: int) -> int:
    """Levels above `n` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def climb(digests: np.ndarray, levels: int) -> list[np.ndarray]:
    """The matrices of a block: `digests` (n, 64) and those of the `levels` above."""
    out = [digests]
    for _ in range(levels):
        below = np.ascontiguousarray(out[-1])
        whole = len(below) // FANOUT
        names = [_hex(row) for row in below[: whole * FANOUT].reshape(whole, FANOUT * HEX)]
        if len(below) % FANOUT:
            names.append(_hex(below[whole * FANOUT :].ravel()))
        out.append(np.frombuffer("".join(names).encode(), np.uint8).reshape(-1, HEX))
    return out


def siblings(matrices: list[np.ndarray], at: int) -> list[tuple[bytes, bytes]]:
    """For each level below the last: the digests left and right of the node `at` (or of the node above it) in its run."""
    out = []
    for m in matrices[:-1]:
        first = at - at % FANOUT
        out.append((m[first:at].tobytes(), m[at + 1 : first + FANOUT].tobytes()))
        at //= FANOUT
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        digest = _hex(left + digest + right).encode()
    return digest


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block) of a stream that is sorted by them."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, at: int) -> tuple:
        return batch.column("tree")[at].as_py(), batch.column("block")[at].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column("tree").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        block = batch.column("block").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges, edges[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _flushed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _block() -> Column:
    return F.expr(f"pos div {BLOCK}").alias("block")


_NODE = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])


def up(nodes: DataFrame) -> DataFrame:
    """tree, pos, n, digest of the blocks of `nodes`, which have the same columns: pos counts from 0 in a tree of n nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for g in groups(batches):
                n = g["n"][0].as_py()
                top = climb(_matrix(g["digest"]), min(DEPTH, height(n)))[-1]
                yield g["tree"][0].as_py(), g["block"][0].as_py(), -(-n // BLOCK), top.tobytes().decode()

        return _flushed(rows(), _NODE)

    return _by_block(nodes.select("tree", _block(), "pos", "n", "digest")).mapInArrow(run, "tree string, pos long, n long, digest string")


def _path(cell: pa.Scalar) -> list[tuple[bytes, bytes]]:
    return [(step["l"].encode(), step["r"].encode()) for step in cell.as_py()]


_PATH_TYPE = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
_DOWN = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", _PATH_TYPE), ("subroot", pa.string())])


def down(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """tree, pos, path, subroot of `nodes`, from those of their blocks: each block's row of `paths` stands before its nodes."""
    heads = paths.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "path", "subroot")
    below = nodes.select("tree", _block(), "pos", "n", "digest", F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for g in groups(batches):
                above, subroot, tree = g["path"][0].as_py(), g["subroot"][0].as_py(), g["tree"][0].as_py()
                matrices = climb(_matrix(g["digest"][1:]), min(DEPTH, height(g["n"][1].as_py())))
                for at, pos in enumerate(g["pos"][1:].to_pylist()):
                    yield tree, pos, [{"l": a.decode(), "r": b.decode()} for a, b in siblings(matrices, at)] + above, subroot

        return _flushed(rows(), _DOWN)

    return _by_block(below.unionByName(heads)).mapInArrow(run, f"tree string, pos long, path {_PATH}, subroot string")


def prove(placed: DataFrame, paths: DataFrame, id_type: str) -> DataFrame:
    """doc_id, leaf, subroot, proof_sha256, folded_root of the leaves, from the paths of their blocks."""
    heads = paths.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "path", "subroot",
                         F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("string").alias("tampered"))
    below = placed.select("tree", _block(), "pos", "n", "digest", F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), "doc_id", "tampered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            above, subroot, rows = _path(g["path"][0]), g["subroot"][0].as_py(), g.slice(1)
            tail = b"".join(left + right for left, right in above)
            own = rows["digest"].to_pylist()
            matrices = climb(_matrix(rows["digest"]), min(DEPTH, height(rows["n"][0].as_py())))
            proofs, roots, folded = [], [], {}
            for at, changed in enumerate(rows["tampered"].to_pylist()):
                path = siblings(matrices, at)
                proof = hashlib.sha256(b"".join(left + right for left, right in path))
                proof.update(tail)
                proofs.append(proof.hexdigest())
                top = fold((changed or own[at]).encode(), path)
                if top not in folded:  # most rows fold to the block's own digest
                    folded = {top: fold(top, above).decode()}
                roots.append(folded[top])
            ids = rows["doc_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.string()), pa.array([subroot] * len(own), pa.string()), pa.array(proofs, pa.string()), pa.array(roots, pa.string())], names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return _by_block(below.unionByName(heads)).mapInArrow(run, _OUT.format(id=id_type))


def place(rows: DataFrame, order: list[str], tables: Tables) -> DataFrame:
    """`rows` with pos, their place in their tree (from 0) in `order`, and n, the tree's rows; no tree is held by one task."""
    row = tables.write(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    runs = row.groupBy(F.col("tree").alias("of"), part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = runs.groupBy(F.col("of").alias("whole")).agg(F.sum("size").alias("n"))
    runs = runs.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(totals, F.col("of").eqNullSafe(F.col("whole"))).drop("whole")
    joined = row.join(runs, F.col("tree").eqNullSafe(F.col("of")) & (part == F.col("part")))
    return joined.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def rounds(leaves: DataFrame, tables: Tables) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that each round reads, the leaves first, and the one node that is left of each tree."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while True:
        top = tables.write(up(levels[-1]), "nodes")
        most = -(-most // BLOCK)
        if most <= 1:
            return levels, top
        levels.append(top)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of `docs`."""
    tables = Tables(docs.sparkSession, "merkle")
    found = leaves(docs)
    id_type = found.schema["doc_id"].dataType.simpleString()
    placed = tables.write(place(found, ["doc_id", "digest"], tables), "leaves")
    levels, subroots = rounds(placed, tables)
    # the tree over the groups: a group's name orders it, and stays outside the tree's own columns
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    groups_ = tables.write(place(named, ["group"], tables), "groups")
    upper, top = rounds(groups_.select("tree", "pos", "n", "digest"), tables)
    root = top.select("digest").first()
    paths = top.select("tree", "pos", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(upper):
        paths = tables.write(down(nodes, paths), "paths")
    paths = paths.drop("subroot").join(groups_.select("pos", "group", F.col("digest").alias("subroot")), "pos").select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot")
    for nodes in reversed(levels[1:]):
        paths = tables.write(down(nodes, paths), "paths")
    out = prove(placed, paths, id_type)
    whole = F.lit(root["digest"] if root else None).cast("string")
    out = written(out.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified")), "manifest")
    tables.drop()
    return out


def _oracle(source_levels: int = 7, group_levels: int = 6) -> str:
    """SQL for tables of at most 16 ** source_levels rows a source and 16 ** group_levels sources."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf_of = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # unsigned CRC-32 of the id as text: eight shifts (-1) after each byte
    crc = ("xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),"
           " lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295)")  # fmt: skip
    parts = [
        f"t AS (SELECT doc_id, source, {leaf_of('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf_of(lower)} END AS tampered FROM documents)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM t)",
    ]
    tree = lambda name, k, key: f"{name}{k} AS (SELECT {key}, pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM ({{}}))"
    parts.append(tree("a", 0, "source").format("SELECT source, pos, leaf AS h FROM s0"))
    run = lambda name, k, key: f"{name}r{k} AS (SELECT {key}, pos // 16 AS run, string_agg(h, '' ORDER BY pos) AS hs, max(n) AS n FROM {name}{k} GROUP BY ALL)"
    for k in range(source_levels):
        parts += [run("a", k, "source"), tree("a", k + 1, "source").format(f"SELECT source, run AS pos, CASE WHEN n > 1 THEN sha256(hs) ELSE hs END AS h FROM ar{k}")]
    parts.append(f"g0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n, source FROM a{source_levels})")
    for k in range(group_levels):
        parts += [run("g", k, "one"), tree("g", k + 1, "one").format(f"SELECT one, run AS pos, CASE WHEN n > 1 THEN sha256(hs) ELSE hs END AS h FROM gr{k}")]
    state, at = "SELECT s0.doc_id, s0.source, s0.leaf, s0.pos, '' AS proof, coalesce(s0.tampered, s0.leaf) AS d FROM s0", 0
    step = "SELECT x.* EXCLUDE (proof, d, pos), x.pos // 16 AS pos, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof, CASE WHEN n > 1 THEN sha256(l || d || r) ELSE d END AS d FROM (SELECT x.*, q.n, substr(q.hs, 1, 64 * (x.pos % 16)) AS l, substr(q.hs, 64 * (x.pos % 16) + 65) AS r FROM w{at} x JOIN {runs} q ON q.run = x.pos // 16{more}) x"
    parts.append(f"w0 AS ({state})")
    for k in range(source_levels):
        parts.append(f"w{at + 1} AS (SELECT * EXCLUDE (n, l, r) FROM (" + step.format(at=at, runs=f"ar{k}", more=" AND q.source IS NOT DISTINCT FROM x.source") + "))")
        at += 1
    parts.append(f"w{at + 1} AS (SELECT x.* EXCLUDE (pos), g0.pos, g0.h AS subroot FROM w{at} x JOIN g0 ON g0.source IS NOT DISTINCT FROM x.source)")
    at += 1
    for k in range(group_levels):
        parts.append(f"w{at + 1} AS (SELECT * EXCLUDE (n, l, r) FROM (" + step.format(at=at, runs=f"gr{k}", more="") + "))")
        at += 1
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, g.h AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = g.h AS verified FROM w{at}, g{group_levels} g"


ORACLE = _oracle()
