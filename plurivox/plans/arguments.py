"""Arguments over `embeddings`: vectors are claims, labels leaves, every fourth label a parent; even leaves are divided by a proposition, and stances go by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arguments
from ..sources.shared import checkpointed
from .base import Catalogue, read

C = Catalogue()
KEYS = ["leaf", "side"]
#: The supplied vectors hardly cluster, so the bounds are low.
NEAR, SUPPORT, SAME, MOST = 0.2, 0.15, 0.25, 3


def _claims(spark, d):
    id_ = F.col("vec_id")
    stance = F.element_at(F.array(*map(F.lit, ("for", "against", "nuance"))), (id_ % 3 + 1).cast("int"))
    rows = read(spark, d, "embeddings").select(id_.alias("id"), F.col("label").cast("long").alias("leaf"), stance.alias("stance"), F.col("embedding").cast("array<double>").alias("vector"), (id_ % 4 + 1).cast("double").alias("weight"))
    return arguments.groups(rows, rows.where("leaf % 2 = 0").select("leaf"))


def _arguments(spark, d):
    claims = checkpointed(_claims(spark, d))
    return arguments.support(claims, checkpointed(arguments.cover(claims, KEYS, NEAR, MOST, checkpointed)), KEYS, SUPPORT)


def _sql() -> str:
    dot = lambda a, b: f"round(list_dot_product({a}, {b}), 6)"
    parts = ["""e AS (SELECT vec_id AS id, label::BIGINT AS leaf, vec_id % 3 AS st, embedding::DOUBLE[] AS x, vec_id % 4 + 1.0 AS weight FROM embeddings),
        u AS (SELECT *, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS v, CASE WHEN leaf % 2 = 1 THEN 'neutral' WHEN st = 0 THEN 'for' WHEN st = 1 THEN 'against' END AS side FROM e),
        g AS (SELECT * FROM u WHERE side IS NOT NULL QUALIFY count(*) OVER (PARTITION BY leaf, side) >= 3),
        p AS (SELECT leaf, side, pos, sum(y) AS s FROM (SELECT leaf, side, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM g) GROUP BY ALL), c AS (SELECT leaf, side, list(s ORDER BY pos) AS c FROM p GROUP BY ALL),
        o0 AS (SELECT g.*, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS central FROM g JOIN c USING (leaf, side))"""]  # fmt: skip
    for k in range(MOST):
        parts.append(f"s{k} AS (SELECT leaf, side, {k} AS pick, id, v FROM o{k} QUALIFY row_number() OVER (PARTITION BY leaf, side ORDER BY central DESC, id) = 1)")
        parts.append(f"o{k + 1} AS (SELECT o{k}.* FROM o{k} JOIN s{k} USING (leaf, side) WHERE {dot(f'o{k}.v', f's{k}.v')} < {NEAR} AND o{k}.id <> s{k}.id)")
    parts.append("picks AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(MOST)) + ")")
    parts.append(f"m AS (SELECT g.leaf, g.side, g.id AS claim, g.weight, pick, picks.id, picks.v, {dot('g.v', 'picks.v')} AS s FROM g JOIN picks USING (leaf, side) QUALIFY row_number() OVER (PARTITION BY g.leaf, g.side, g.id ORDER BY s DESC, pick) = 1)")
    parts.append(f"a AS (SELECT leaf, side, pick, id, any_value(v) AS v, count(*) AS n_support, round(sum(weight), 3) AS weight, list({{'i': claim, 's': s}} ORDER BY s DESC, claim)[1:5] AS sources FROM m WHERE s >= {SUPPORT} GROUP BY leaf, side, pick, id HAVING count(*) >= 3)")
    return "WITH " + ", ".join(parts)


@C.query(_sql() + " SELECT leaf, side, CAST(pick AS INTEGER) AS pick, id, n_support, weight, array_to_string(list_transform(sources, lambda x: x.i), ',') AS sources FROM a")
def leaf_arguments(spark, d):
    """The claims that stand for each side of each leaf, with their support."""
    ids = F.array_join(F.transform("sources", lambda s: s["id"].cast("string")), ",")
    return _arguments(spark, d).select("leaf", "side", "pick", "id", "n_support", "weight", ids.alias("sources"))


@C.query(_sql() + f""", n AS (SELECT leaf % 4 AS parent, * FROM a), l AS (SELECT parent, side, list({{'i': id, 'v': v}} ORDER BY n_support DESC, id) AS es FROM n GROUP BY ALL),
    h AS (SELECT parent, side, list_reduce(list_concat([list_filter(es, lambda e: false)], list_transform(es, lambda e: [e])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: round(list_dot_product(y.v, x[1].v), 6) >= {SAME})) = 0 THEN list_concat(acc, x) ELSE acc END) AS hs FROM l),
    f AS (SELECT parent, side, unnest(hs).i AS home, unnest(hs).v AS hv, unnest(range(len(hs))) AS k FROM h),
    j AS (SELECT n.*, f.home, f.k FROM n JOIN f USING (parent, side) WHERE round(list_dot_product(n.v, hv), 6) >= {SAME} QUALIFY row_number() OVER (PARTITION BY n.parent, n.side, n.id ORDER BY k) = 1),
    t AS (SELECT parent, side, home, sum(n_support)::BIGINT AS ns, round(sum(weight), 3) AS weight, list_sort(list(DISTINCT leaf)) AS leaves, min(k) AS k FROM j GROUP BY ALL),
    src AS (SELECT parent, side, home, list(i ORDER BY s DESC, i)[1:5] AS sources FROM (SELECT parent, side, home, unnest(sources).i AS i, unnest(sources).s AS s FROM j) GROUP BY ALL)
    SELECT parent, side, CAST(rank AS INTEGER) AS rank, home AS id, ns AS n_support, weight, array_to_string(leaves, ',') AS merged_from, array_to_string(sources, ',') AS sources
    FROM (SELECT *, row_number() OVER (PARTITION BY parent, side ORDER BY ns DESC, k) AS rank FROM t) JOIN src USING (parent, side, home) WHERE rank <= 7""")
def merged_arguments(spark, d):
    """The arguments of a parent's leaves, near ones absorbed by the better supported."""
    entries = checkpointed(_arguments(spark, d).withColumn("parent", F.col("leaf") % 4))
    rows = arguments.merged(entries, ["parent", "side"], SAME)
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("parent", "side", "rank", "id", "n_support", "weight", text(F.col("merged_from")).alias("merged_from"), text(F.transform("sources", lambda s: s["id"])).alias("sources"))


QUERIES, ORACLES = C.queries, C.oracles
