"""The vectors of `embeddings` as a space: components, silhouettes, degrees, and how far communities hold."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from ..functions import masks
from ..operators import community, space, stability, vector
from ..sources.shared import checkpointed
from .base import Catalogue, read
from .vectors import _KNN, EDGE, _knn

C = Catalogue()


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@C.query()
def components_removed(spark, d):
    """Vectors less their mean and two leading components: length and cosine to the original (a decomposition, so without SQL)."""
    vs = _vectors(spark, d).select("vec_id", "v")
    less = space.without_components(vs, "v", 2).withColumnRenamed("v", "u")
    return less.join(vs, "vec_id").select("vec_id", F.round(vector.norm(F.col("u")), 6).alias("norm"), F.round(vector.dot(F.col("u"), vector.normalised(F.col("v"))), 6).alias("cosine"))


@C.query("""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
    f AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE 1 - list_dot_product(a.v, b.v) END) AS s, count(*) AS n FROM u a, u b GROUP BY ALL),
    m AS (SELECT vec_id, label, max(CASE WHEN label = other THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE NULL END END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM f GROUP BY ALL)
    SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m GROUP BY label""")
def silhouette(spark, d):
    """Mean silhouette of each theme by cosine distance."""
    rows = space.silhouettes(_vectors(spark, d), "vec_id", "label", "v", checkpointed)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@C.query(f"""WITH l AS (SELECT round(w, 6) AS threshold, count(*) AS n FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(cosine) AS w FROM ({_KNN}) GROUP BY 1, 2) GROUP BY 1), s AS (SELECT threshold, sum(n) OVER (ORDER BY threshold DESC)::BIGINT AS edges FROM l)
    SELECT min(threshold) AS threshold, max(edges) AS edges FROM s WHERE 2 * edges <= 6.0 * (SELECT count(*) FROM embeddings)""")
def degree_threshold(spark, d):
    """The threshold at which the neighbour graph has six edge ends a node."""
    return space.degree_threshold(vector.edges(_knn(spark, d), -1.0), read(spark, d, "embeddings").count(), 6.0)


@C.query()
def bootstrap_agreement(spark, d):
    """Agreement of the communities of four resamples (iterative, so without SQL)."""
    return stability.agreement(checkpointed(stability.resampled(checkpointed(vector.edges(_knn(spark, d), EDGE)), 0.8, range(4), checkpointed)))


@C.query()
def layer_chain(spark, d):
    """Nested levels over neighbourhoods of several sizes (iterative, so without SQL)."""
    return stability.chain(checkpointed(_knn(spark, d)), [3, 5, 7, 10], 0.0, checkpointed, 1.2)


@C.query()
def deletion_shapes(spark, d):
    """The shape of the two-level tree, whole and after one per cent of the vectors are taken out, twice (iterative, so without SQL)."""
    links, vs = checkpointed(vector.edges(_knn(spark, d), EDGE)), _vectors(spark, d).select(F.col("vec_id").alias("node"), F.col("v").alias("vector"))
    keep = lambda c, s: F.lit(True) if s == 0 else stability.sampled(c, s, 0.99)
    runs = lambda *cs: F.explode(F.array_compact(F.array(*(F.when(reduce(and_, (keep(c, s) for c in cs)), F.lit(s).cast("long")) for s in range(3))))).alias("run")
    trees = checkpointed(community.two_levels(links.select(runs("a", "b"), "a", "b", "w"), vs.select(runs("node"), "node"), vs, 3, checkpointed, 0.7, 1.4))
    shapes = [stability.shape(trees.where(F.col("run") == s)).withColumn("seed", F.lit(s)) for s in range(3)]
    return shapes[0].unionByName(shapes[1]).unionByName(shapes[2])


_MASKS = [("[A-Z][a-z]+ [a-z]+", "[name]"), ("(?:and|und|et|y) [a-z]+", "[pair]"), ("[a-z]+[.]", "[end]"), ("[0-9]+", "[number]")]


def _matches_sql(pattern: str, mark: str) -> str:
    pieces, found = f"string_split_regex(text, '{pattern}')", f"regexp_extract_all(text, '{pattern}')"
    at = f"coalesce(list_sum(list_transform(list_slice({pieces}, 1, k), lambda x: length(x))), 0) + coalesce(list_sum(list_transform(list_slice({found}, 1, k - 1), lambda x: length(x))), 0)"
    return f"SELECT doc_id, text, {at} AS s, {at} + length({found}[k]) AS e, '{mark}' AS m FROM (SELECT doc_id, text, unnest(range(1, len({found}) + 1)) AS k FROM documents)"


@C.query(f"""WITH x AS ({" UNION ALL ".join(_matches_sql(p, m) for p, m in _MASKS)}), l AS (SELECT doc_id, text, list({{'s': s::BIGINT, 'e': e::BIGINT, 'm': m}} ORDER BY s, e, m) AS xs FROM x GROUP BY ALL),
    k AS (SELECT doc_id, text, list_reduce(list_concat([list_filter(xs, lambda y: false)], list_transform(xs, lambda y: [y])), lambda a, y: CASE WHEN len(a) > 0 AND y[1].s < a[len(a)].e THEN a ELSE list_concat(a, y) END) AS ks FROM l),
    p AS (SELECT doc_id, text, unnest(ks).s AS s, unnest(ks).e AS e, unnest(ks).m AS m, unnest(range(len(ks))) AS i FROM k), q AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY i), 0) AS last, lead(s) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS final FROM p),
    r AS (SELECT doc_id, string_agg(substr(text, last + 1, s - last) || m || CASE WHEN final THEN substr(text, e + 1) ELSE '' END, '' ORDER BY i) AS masked FROM q GROUP BY doc_id)
    SELECT doc_id, md5(coalesce(masked, text)) AS masked_md5 FROM documents LEFT JOIN r USING (doc_id)""")
def overlapping_masks(spark, d):
    """The matches of several patterns masked at once, the first of overlapping ones."""
    return read(spark, d, "documents").select("doc_id", F.md5(masks.mask_all(F.col("text"), _MASKS)).alias("masked_md5"))


@C.query()
def anonymised_texts(spark, d):
    """How many marks of each kind the extended masking puts into each language's texts (lookarounds, so without SQL)."""
    rows = read(spark, d, "documents").select("lang", masks.anonymise(F.col("text")).alias("m"))
    count = lambda mark: F.sum(F.regexp_count("m", F.lit(rf"\[{mark}\]"))).cast("long").alias(mark)
    return rows.groupBy("lang").agg(*(count(m) for m in ("email", "url", "mention", "reseau", "adresse", "numero", "tel")))


QUERIES, ORACLES = C.queries, C.oracles
