"""N-gram Jaccard join by parity sketches: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Documents with one set are one node (named by a signature of the set), so exact copies never form pairs.

Sketches. The places of a set's band are cut into k blocks. Each shingle toggles (XOR) one bit of a wide sketch: its
block, and a place in the block. The sketches of A and B differ in at most as many bits as their symmetric
difference has shingles: the Hamming distance is a lower bound of it. A block's bits are kept as the XOR of the mixed
hashes of its shingles, which is equal wherever the bits are.

Bands and pigeonhole. Similar sets have sizes within a factor 1.25, so they lie in one size band or in neighbouring ones;
a set joins in its own band and in the next. There the symmetric difference of similar sets is at most d =
(|A| + |B|) / 9. With k = d + m blocks at least m blocks have no difference. Blocks without a shingle say nothing, so
only others become keys: if one of the two sets has fewer than m empty blocks, the pair meets in a key. A set with
more hashes again by the next seed, until it has fewer. First only shingles that are rare in a sample count, so that a
passage of many documents makes no keys; sets without enough of these make keys of all their shingles too, and sets
left after all seeds share one more key a band. So no similar pair is lost, whatever counts as rare.

Hot groups. A key's nodes are never paired with each other. First every node is checked against the most central node of
its keys, the one that shares keys with most nodes. Then only keys with several components are looked at. A shingle that
only one of all their nodes has is a difference to every other: nodes with too many of these have no similar set in a key and leave it.
There one pivot stands for the nodes linked to it: by the triangle inequality of the symmetric difference two pivots
further apart than the bound plus both radii have no similar nodes. Only what this leaves open is checked node by node, once for all
keys that two pivots share.
The joins themselves compare short parity sketches, so that pairs too far apart never become rows, and longer sketches
follow before any text moves. A step sends its nodes of one key once, settled if there are several.

Nodes are named by 64 bits of a signature; where an independent signature tells two sets of one name apart, the nodes
of that name are named by the second one.

Verification compares whole sets, streamed by leader in salted groups of bounded memory; a folded parity sketch rules pairs out first.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; fewer words than a shingle
are one shingle; a null doc_id belongs to no link and is its own (null) component; rows that share a doc_id link their
sets; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange, shared
from .components import components
from .shared import Tables, mix, written

SHINGLE = 5
#: Similarity 0.8: the symmetric difference is at most a ninth of the sum of the sizes, NUM / DEN.
NUM, DEN = 80, 100
SEEDS = 8
FOLD_BITS = 4096
#: Longs of the short parity sketch that joins compare.
SHORT = 8
_SHORT = [f"f{j}" for j in range(SHORT)]
#: Members of one leader that one group verifies.
SALT_ROWS = 256
BROADCAST_IDS = 2_000_000
#: Documents, least number of them and most shingles of the choice of common shingles.
SAMPLE, COMMON, COMMON_MOST = 4096, 8, 500_000
_U = np.uint64
_LOW = _U((1 << 48) - 1)


def limit(total):
    """The largest symmetric difference of similar sets whose sizes sum to `total`."""
    return total * (DEN - NUM) // (DEN + NUM)


def bands(largest: int) -> list[tuple[int, int, int, int]]:
    """(lo, hi, k, m) of each size band [lo, hi)."""
    out, lo, before = [], 4, 4
    while True:
        hi = max(lo + 1, -(-lo * DEN // NUM))
        d = limit(2 * (hi - 1))
        m = 1
        while True:  # enough blocks that a set seldom has m empty ones
            k = d + m
            empty = k * (1 - 1 / k) ** before if k > 1 else 0.0
            if m >= 1 + int(empty + empty**0.5):
                break
            m += 1
        out.append((lo, hi, k, m))
        if lo > largest:
            return out
        before, lo = lo, hi


def sets(words: shared.Words) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each row with words."""
    wide = shared.window_hash(words.hash, SHINGLE)
    for k, (a, b) in enumerate(zip(words.first, words.first[1:])):
        if b - a >= SHINGLE:
            yield k, np.unique(wide[a : b - SHINGLE + 1])
        elif b > a:
            short = _U(b - a)
            for h in words.hash[a:b]:
                short = mix(np.array([short ^ h]) * _U(0x9E3779B97F4A7C15))[0]
            yield k, np.array([short], dtype=np.uint64)


def signatures(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit signatures of a set."""
    out = []
    for salt in (1, 0x7F4A7C15):
        h = mix(np.array([np.bitwise_xor.reduce(mix(s + _U(salt)))], dtype=np.uint64) + np.array([mix(s ^ _U(salt)).sum(dtype=np.uint64)]) * _U(3) + _U(len(s)))
        out.append(int(h.view(np.int64)[0]))
    return out[0], out[1]


def node_of(s: np.ndarray, split: frozenset[int] = frozenset()) -> int:
    """The node of a set: its first signature, or the second where different sets share the first."""
    first, second = signatures(s)
    return second if first in split else first


def _blocks(s: np.ndarray, band: int, k: int, seed: int, space: int) -> np.ndarray:
    """One key for each block of `s` that holds a shingle."""
    h = np.sort(mix(s + _U(seed * 0x51ED27 + band)))
    block = ((h >> _U(32)) * _U(k)) >> _U(32)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    bits = np.bitwise_xor.reduceat(mix(h), first)
    return mix(bits ^ mix(block[first] * _U(SEEDS) + _U(seed)) ^ mix(np.array([band * 2 + space + 7], np.uint64)))


def keys(s: np.ndarray, table: list[tuple[int, int, int, int]], common: np.ndarray) -> np.ndarray:
    """The keys under which a set can meet similar sets. `common`: sorted shingles that say little; any choice is exact."""
    n = len(s)
    if n < 4:  # similar to equal sets alone
        return np.zeros(0, np.uint64)
    own = next(i for i, (lo, hi, _, _) in enumerate(table) if lo <= n < hi)
    rare = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s] if len(common) else s
    out = []
    for band in (own, own + 1):
        _, _, k, m = table[band]
        for space, part in enumerate((rare, s)):
            safe = False
            for seed in range(SEEDS if len(part) else 0):
                out.append(_blocks(part, band, k, seed, space))
                safe = k - len(out[-1]) < m
                if safe:
                    break
            if safe:
                break
        else:
            out.append(mix(np.array([band], np.uint64) ^ _U(0xABCDEF)))
    return np.concatenate(out)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted shingles of at least COMMON of the SAMPLE documents with the smallest hashed ids, COMMON_MOST at most.

    They only steer which keys are made: the join is exact whatever they are."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches):
            found = [s for _, s in sets(shared.Words(step.column(1)))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "h long")
    often = rows.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON).orderBy(F.desc("c"), "h").limit(COMMON_MOST)
    return np.sort(np.array([r[0] for r in often.select("h").collect()], dtype=np.int64).view(np.uint64))


def sketch(s: np.ndarray) -> bytes:
    """The parity sketch of a set, with as many bits as the next power of two from its size on, 64 at least."""
    return parity(s, 1 << max(6, (len(s) - 1).bit_length())).tobytes()


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits(np.bincount((mix(s ^ _U(0x5DEECE66D)) % _U(bits)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little")


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer folded onto the shorter: a lower bound of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def fold(s: np.ndarray) -> np.ndarray:
    """A parity sketch of FOLD_BITS bits."""
    return np.bincount((mix(s ^ _U(0x5DEECE66D)) % _U(FOLD_BITS)).astype(np.int64), minlength=FOLD_BITS) & 1


def documents_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), node and other (signatures of the set; null for an empty one), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches):
            n, node, other, bits = np.zeros(step.num_rows, np.int64), [None] * step.num_rows, [None] * step.num_rows, [None] * step.num_rows
            short = np.zeros((SHORT, step.num_rows), np.int64)
            for k, s in sets(shared.Words(step.column(1))):
                n[k], bits[k], short[:, k] = len(s), sketch(s), parity(s, SHORT * 64).view(np.int64)
                node[k], other[k] = signatures(s)
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n), pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(bits, pa.binary()), *map(pa.array, short)], names=["doc_id", "n", "node", "other", "sketch", *_SHORT])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, other long, sketch binary, " + ", ".join(f"{c} long" for c in _SHORT))


def _entries(docs: DataFrame, table: list, buckets: int, common: np.ndarray, split: frozenset[int]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "key", "node", "many"]
        for step in shared.steps(batches):
            parts, nodes = [], []
            for _, s in sets(shared.Words(step.column(1))):
                parts.append(keys(s, table, held.value))
                nodes.append(np.full(len(parts[-1]), node_of(s, split), np.int64))
            if not parts or not sum(map(len, parts)):
                continue
            key, node = np.concatenate(parts) & _LOW, np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node = key[new], node[new]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            several = np.repeat(size > 1, size)
            full, _, blobs = exchange.pack(key[start], buckets, exchange.narrow(key[start]), node[start], (size > 1).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(full), *blobs], names=names)
            if several.any():
                cuts = np.array([0, int(several.sum())])
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(key[0] % _U(buckets))], pa.int32()), exchange.blob(exchange.narrow(key[several]), cuts), exchange.blob(node[several], cuts), exchange.blob(np.zeros(0, np.uint8), np.array([0, 0]))], names=names)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "bucket int, key binary, node binary, many binary")


def _answer(part: pa.Table) -> pa.Table:
    """Members of the keys that two nodes or more share."""
    key, node = exchange.wide(exchange.joined(part["key"], np.uint8).tobytes()), exchange.joined(part["node"], np.int64)
    if part["bucket"][0].as_py() >= 0:
        many = exchange.joined(part["many"], np.uint8)
        order = np.lexsort((node, key))
        key, node, many = key[order], node[order], many[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[start[1:] - 1, len(key) - 1]
        hit = np.repeat((node[start] != node[last]) | (np.maximum.reduceat(many, start) > 0), np.diff(np.r_[start, len(key)]))
        hit &= np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[hit], node[hit]
    shared.trim()
    return pa.table({"key": key.view(np.int64), "node": node})


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, split: frozenset[int], tables: Tables) -> DataFrame:
    """lead, member, delta (symmetric difference, or a lower bound above limit + slack), linked: `pairs` (lead, member, slack) by their whole sets."""
    spark = docs.sparkSession
    pairs = tables.write(pairs.distinct().withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(1 << 20))), "pairs")
    if pairs.isEmpty():
        return spark.createDataFrame([], "lead long, member long, delta long, linked boolean, slack long")
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts"))
    salted = pairs.join(sizes, "lead").withColumn("salt", F.pmod("salt", F.col("parts")))
    members = salted.select("lead", "salt", F.col("member").alias("node"), "slack", F.lit(1).alias("rank"))
    leads = sizes.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("lead").alias("node"), F.lit(0).cast("long").alias("slack"), F.lit(0).alias("rank"))
    wanted = tables.write(leads.withColumn("salt", F.col("salt").cast("long")).unionByName(members.withColumn("salt", F.col("salt").cast("long"))).join(names, "node"), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS // 4 else wanted
    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(side, "rep").select("lead", "salt", "rank", "node", "slack", "text")
    grouped = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "rank", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = lead_set = lead_fold = None
        for step in shared.steps(batches):
            out: list[tuple] = []
            found = dict(sets(shared.Words(step.column(5))))
            lead, salt, rank, node, slack = (step.column(c).to_pylist() for c in range(5))
            seen = None
            for k in range(step.num_rows):
                s = found.get(k)
                if s is None or node_of(s, split) != node[k]:  # another text of a repeated doc_id
                    continue
                if rank[k] == 0:
                    group, lead_set, lead_fold = (lead[k], salt[k]), s, fold(s)
                    continue
                if group != (lead[k], salt[k]) or seen == (group, node[k]):
                    continue
                seen = (group, node[k])
                bound = limit(len(s) + len(lead_set))
                delta = int((fold(s) != lead_fold).sum())
                if delta <= bound + slack[k]:
                    both = len(np.intersect1d(s, lead_set, assume_unique=True))
                    delta = len(s) + len(lead_set) - 2 * both
                    linked = DEN * both >= NUM * (len(s) + len(lead_set) - both)
                else:
                    linked = False
                out.append((lead[k], node[k], delta, linked, slack[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["lead", "member", "delta", "linked", "slack"])

    return tables.write(grouped.mapInArrow(run, "lead long, member long, delta long, linked boolean, slack long"), "verified")


def _alone(docs: DataFrame, names: DataFrame, split: frozenset[int]) -> DataFrame:
    """node, alone: how many shingles of a node of `names` (node, rep) are in no other of these nodes."""
    side = F.broadcast(names) if names.count() <= BROADCAST_IDS // 4 else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches, text="text"):
            want, parts, nodes = step.column(0).to_pylist(), [], []
            for k, s in sets(shared.Words(step.column(1))):
                if node_of(s, split) == want[k]:
                    parts.append(s)
                    nodes.append(np.full(len(s), want[k], np.int64))
            if parts:
                h, node = np.concatenate(parts), np.concatenate(nodes)
                order = np.argsort(h)
                h, node = h[order], node[order]
                start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(np.minimum.reduceat(node, start)), pa.array(np.maximum.reduceat(node, start))], names=["h", "a", "b"])

    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(side, "rep").select("node", "text").mapInArrow(run, "h long, a long, b long")
    ones = rows.groupBy("h").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a = b")
    return ones.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("alone"))


def _near(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The `pairs` (pivot1, pivot2, slack, bound) whose sketches are at most slack + bound apart."""
    for side in "12":
        pairs = pairs.join(names.select(F.col("node").alias(f"pivot{side}"), F.col("sketch").alias(f"sketch{side}")), f"pivot{side}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            ok = [hamming(a.as_py(), b.as_py()) <= m for a, b, m in zip(batch.column(4), batch.column(5), most)]
            yield batch.select(["pivot1", "pivot2", "slack", "bound"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("pivot1", "pivot2", "slack", "bound", "sketch1", "sketch2").mapInArrow(run, "pivot1 long, pivot2 long, slack long, bound long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (verified links of the document's set to other sets)."""
    tables = Tables(docs.sparkSession, "jaccard", small=True)
    nodes = tables.write(documents_sets(docs), "sets")
    twice = nodes.where("node is not null").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a != b")
    split = frozenset(r[0] for r in twice.select("node").collect())  # chance collisions of 64 bits alone
    if split:
        nodes = nodes.withColumn("node", F.when(F.col("node").isin(sorted(split)), F.col("other")).otherwise(F.col("node")))
    live = nodes.where("node is not null and doc_id is not null")
    names = tables.write(live.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), *(F.max(c).alias(c) for c in _SHORT)), "names")
    largest = names.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    table = bands(largest)
    entries = _entries(docs, table, exchange.buckets_for(docs), common_shingles(docs), split)
    shared_keys = tables.write(entries.groupBy("bucket").applyInArrow(_answer, "key long, node long").distinct(), "keys")
    shared.release(docs.sparkSession)
    who, sizes, short = names.select("node", "rep"), names.select("node", "n"), names.select("node", *_SHORT)

    # every node against the most central node of most of its keys: the one that shares keys with most nodes
    sizes_of = shared_keys.groupBy("key").agg(F.count("*").alias("c"))
    central = tables.write(shared_keys.join(sizes_of, "key").groupBy("node").agg(F.sum("c").alias("weight")), "central")
    lead = shared_keys.join(central, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("lead"))
    stars = shared_keys.join(lead, "key").where("node != lead").groupBy("node", "lead").agg(F.count("*").alias("c"))
    best = stars.join(central.withColumnRenamed("node", "lead"), "lead").groupBy("node").agg(F.max_by("lead", F.struct("c", "weight", "lead")).alias("lead"))
    first = _verified(best.select("lead", F.col("node").alias("member"), F.lit(0).cast("long").alias("slack")), docs, who, split, tables)
    links = first.where("linked").select(F.col("lead").alias("a"), F.col("member").alias("b"))
    comp = components(links)
    pivots = first.where("linked").select(F.col("member").alias("node"), F.col("lead").alias("pivot"), F.col("delta").alias("r"))
    info = tables.write(
        shared_keys.select("node").distinct().join(comp, "node", "left").join(pivots, "node", "left").join(sizes, "node")
        .select("node", F.coalesce("component", "node").alias("component"), F.coalesce("pivot", "node").alias("pivot"), F.coalesce("r", F.lit(0)).alias("r"), "n"),
        "info",
    )

    shared.release(docs.sparkSession)
    # keys that still hold several components, without the nodes whose own shingles alone rule out every other node of the key
    held = tables.write(_mixed(shared_keys.join(info, "node")), "mixed")
    alone = _alone(docs, held.select("node").distinct().join(who, "node"), split)
    # overlap <= n - alone, so the difference to a set of m shingles is at least m - n + 2 * alone
    held = held.join(alone, "node", "left").withColumn("own", 2 * F.coalesce("alone", F.lit(0)) - F.col("n")).drop("alone")
    least = held.groupBy("key").agg(F.min("n").alias("least"))
    possible = F.expr(f"least + own <= (n + least) * {DEN - NUM} div {DEN + NUM}")
    inside = F.expr(f"{DEN} * (n - own) >= {2 * NUM} * n")
    held = tables.write(_mixed(held.join(least, "key").where(possible & inside).drop("least")), "possible")

    # by pivots: the join itself compares short parity sketches
    by_pivot = held.groupBy("key", "pivot", "component").agg(F.max("r").alias("r"), F.max("n").alias("n"), F.min("n").alias("m"), F.min("own").alias("own"))
    by_pivot = tables.write(by_pivot.join(short.withColumnRenamed("node", "pivot"), "pivot"), "pivots")
    left, right = (by_pivot.select("key", *(F.col(c).alias(f"{c}{s}") for c in ("pivot", "component", "r", "n", "m", "own", *_SHORT))) for s in "12")
    bound = F.expr(f"(n1 + n2) * {DEN - NUM} div {DEN + NUM}")
    apart = F.greatest(F.col("m1") - F.col("n2"), F.col("m2") - F.col("n1"), F.col("m1") + F.col("own2"), F.col("m2") + F.col("own1")) <= bound
    open_keys = left.join(right, "key").where((F.col("pivot1") < F.col("pivot2")) & (F.col("component1") != F.col("component2")) & apart & (_distance() <= bound + F.col("r1") + F.col("r2")))
    open_keys = tables.write(open_keys.select("pivot1", "pivot2", (F.col("r1") + F.col("r2")).alias("slack"), bound.alias("bound")), "open-keys")
    open_pairs = open_keys.groupBy("pivot1", "pivot2").agg(F.max("slack").alias("slack"), F.max("bound").alias("bound"))
    open_pairs = tables.write(_near(open_pairs, names), "open")
    tried = first.select(F.least("lead", "member").alias("pivot1"), F.greatest("lead", "member").alias("pivot2"))
    second = _verified(open_pairs.join(tried, ["pivot1", "pivot2"], "left_anti").select(F.col("pivot1").alias("lead"), F.col("pivot2").alias("member"), (F.col("slack") + F.col("bound")).alias("slack")), docs, who, split, tables)
    distances = second.unionByName(first).select(F.least("lead", "member").alias("pivot1"), F.greatest("lead", "member").alias("pivot2"), "delta", "linked")
    pairs_of = lambda x: x.where("linked").select(F.col("lead").alias("a"), F.col("member").alias("b"))
    now = tables.write(components(links.union(pairs_of(second))), "components")
    unsure = open_pairs.where("slack > 0").join(distances, ["pivot1", "pivot2"]).where("not linked and delta <= slack + bound").select("pivot1", "pivot2", "delta")
    for s in "12":  # pivots that other links have joined meanwhile are settled
        unsure = unsure.join(now.select(F.col("node").alias(f"pivot{s}"), F.col("component").alias(f"now{s}")), f"pivot{s}", "left").withColumn(f"now{s}", F.coalesce(f"now{s}", f"pivot{s}"))
    # node by node, once for all keys that two pivots share: the pivot with fewer nodes first, the nodes of the other in parts
    members = tables.write(held.select("pivot", "node", "r", "n", "own").distinct().join(short, "node"), "members")
    unsure = tables.write(_by_size(unsure.where("now1 != now2").select("pivot1", "pivot2", "delta"), members), "unsure")
    ones, twos = (members.select(*(F.col(c).alias(f"{c}{s}") for c in ("node", "pivot", "r", "n", "own", *_SHORT))) for s in "12")
    parts_of = unsure.select("pivot2", "parts").distinct()
    twos = twos.join(parts_of, "pivot2").withColumn("part", F.pmod(F.xxhash64("node2"), F.col("parts"))).drop("parts")
    likely = F.expr("greatest(abs(n1 - n2), n1 + own2, n2 + own1, delta - r1 - r2)") <= bound
    aims = unsure.join(ones, "pivot1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    third = aims.join(twos, ["pivot2", "part"]).where(likely & (_distance() <= bound) & F.expr("node1 != pivot1 or node2 != pivot2"))
    third = third.select(F.least("node1", "node2").alias("pivot1"), F.greatest("node1", "node2").alias("pivot2"), F.lit(0).cast("long").alias("slack"), bound.alias("bound"))
    third = _verified(_near(third.distinct(), names).select(F.col("pivot1").alias("lead"), F.col("pivot2").alias("member"), "slack"), docs, who, split, tables)

    links = links.union(pairs_of(second)).union(pairs_of(third))
    # rows that share a doc_id tie their sets together
    several = live.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("a", "doc_id")
    tied = live.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a != b")
    comp = components(links.union(tied))
    counts = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    labelled = names.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = labelled.join(smallest, "component").join(counts, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = nodes.join(final, "node", "left").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.coalesce(F.min("component_id"), F.col("doc_id")).alias("component_id"), F.coalesce(F.max("n_links"), F.lit(0)).alias("n_links"))
    out = written(out, "jaccard")
    tables.drop()
    shared.release(docs.sparkSession)
    return out


def _by_size(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The `pairs` (pivot1, pivot2, delta) with the pivot of fewer `members` (pivot, node) first, and `parts`: into how many the nodes of the other are dealt."""
    sizes = members.groupBy("pivot").agg(F.count("*").alias("size"))
    for s in "12":
        pairs = pairs.join(sizes.select(F.col("pivot").alias(f"pivot{s}"), F.col("size").alias(f"size{s}")), f"pivot{s}")
    swap = F.col("size1") > F.col("size2")
    first, second = F.when(swap, F.col("pivot2")).otherwise(F.col("pivot1")), F.when(swap, F.col("pivot1")).otherwise(F.col("pivot2"))
    return pairs.select(first.alias("pivot1"), second.alias("pivot2"), "delta", F.ceil(F.greatest("size1", "size2") / SALT_ROWS).alias("parts"))


def _distance() -> Column:
    """Hamming distance of the short parity sketches of sides 1 and 2: a lower bound of the symmetric difference."""
    return F.expr(" + ".join(f"bit_count({c}1 ^ {c}2)" for c in _SHORT))


def _mixed(held: DataFrame) -> DataFrame:
    """The rows (key, node, component, ...) of keys that hold several components."""
    several = held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    return held.join(several, "key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` of the smallest doc_id of each component, each text of an id once; rows without an id stay."""
    gone = written(join(docs).where("doc_id is not null and doc_id != component_id").select("doc_id"), "jaccard-gone")
    kept = shared.without_ids(docs, gone)
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select("doc_id"), "jaccard-again")
    if again.isEmpty():
        return kept
    # of rows that share id and text, the smallest by the other columns, so that a repeated task keeps the same
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    ones = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("o"))
    return shared.without_ids(kept, again).unionByName(ones.select("doc_id", "text", *(F.col("o")[c].alias(c) for c in others)).select(docs.columns))


ORACLE = """
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
    c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id"""
