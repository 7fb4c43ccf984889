"""Queries over `embeddings`: claim vectors (unit norm) with their leaf theme in `label`."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import closure, coarsen, community, node_stats, vector
from ..sources.shared import checkpointed
from .base import Catalogue, read

C = Catalogue()
#: Neighbours and thresholds of the queries; the supplied vectors hardly cluster, so they are low.
K, EDGE, DUP = 10, 0.25, 0.42

_CARDS = """WITH p AS (SELECT label, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) pos FROM {t}),
    s AS (SELECT label, pos, sum(v) s FROM p GROUP BY label, pos), q AS (SELECT label, sum(s * s) ss FROM s GROUP BY label),
    c AS (SELECT label, count(*) n FROM {t} GROUP BY label), m AS (SELECT greatest(1.0, quantile_cont(n, 0.5)) k, sum(n) total FROM c)
    SELECT label, n, round(1 - sqrt(ss) / n, 4) AS dispersion, round(CASE WHEN n > 1 THEN (ss - n) / (n * (n - 1.0)) ELSE 1.0 END, 4) AS consensus,
           round(n / total, 4) AS share, round(n / (n + k) * CASE WHEN n > 1 THEN (ss - n) / (n * (n - 1.0)) ELSE 1.0 END, 4) AS convergence
    FROM q JOIN c USING (label), m"""
_CENTRED = """(WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) pos FROM embeddings), m AS (SELECT pos, avg(v) m FROM p GROUP BY pos),
    d AS (SELECT vec_id, label, pos, v - m AS v FROM p JOIN m USING (pos)), s AS (SELECT vec_id, sqrt(sum(v * v)) AS s FROM d GROUP BY 1)
    SELECT vec_id, label, list(v / s ORDER BY pos) AS embedding FROM d JOIN s USING (vec_id) GROUP BY vec_id, label)"""
_KNN = f"""SELECT src, dst, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cosine DESC, dst) AS rank FROM (
    SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= {K}"""
_EDGES = f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(cosine) AS w FROM ({_KNN}) WHERE cosine >= {EDGE} GROUP BY 1, 2"


@C.query(_CARDS.format(t="embeddings"))
def theme_cards(spark, d):
    """Dispersion, consensus, share and shrunk convergence of each theme."""
    return node_stats.theme_cards(read(spark, d, "embeddings"), "label", "embedding")


@C.query(_CARDS.format(t=_CENTRED))
def centred_theme_stats(spark, d):
    """The same in the space less its mean."""
    return node_stats.theme_cards(vector.centred(read(spark, d, "embeddings"), "vec_id", "embedding"), "label", "embedding")


@C.query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    """Norms."""
    return read(spark, d, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@C.query("SELECT a.vec_id, b.vec_id AS next_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_pair_dot(spark, d):
    """Dot products of neighbouring rows."""
    a = read(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", "next_id", F.round(vector.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


@C.query("""WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS c, unnest(b.embedding)::DOUBLE AS t, generate_subscripts(a.embedding, 1) AS pos, b.vec_id IS NULL AS alone FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 3 <> 0),
    m AS (SELECT vec_id, pos, CASE WHEN alone THEN c ELSE 0.6 * t + 0.4 * c END AS v, alone FROM p) SELECT vec_id, round(sum(CASE WHEN pos <= 4 THEN v END) / CASE WHEN bool_or(alone) THEN 1 ELSE sqrt(sum(v * v)) END, 6) AS head FROM m GROUP BY vec_id""")
def blend_vectors(spark, d):
    """Claims blended with a target where there is one; the sum of the first four components."""
    a = read(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target")).where("vec_id % 3 != 0")
    mixed = vector.blend(F.col("target"), F.col("embedding"), 0.6)
    return a.join(b, "vec_id", "left").select("vec_id", F.round(F.aggregate(F.slice(mixed, 1, 4), F.lit(0.0), lambda s, x: s + x), 6).alias("head"))


def _knn(spark, d):
    return vector.pairs(read(spark, d, "embeddings"), "vec_id", "embedding", K)


@C.query(_KNN)
def knn_topk(spark, d):
    """Exact nearest neighbours by cosine."""
    return _knn(spark, d).select("src", "dst", "cosine", "rank")


@C.query(_EDGES)
def knn_edges(spark, d):
    """The undirected neighbour graph."""
    return vector.edges(_knn(spark, d), EDGE)


@C.query("SELECT a, b, w, round(w * w, 6) AS square, round(w * w * w, 6) AS cube, round(exp(-(1 - w) * (1 - w) / 0.5), 6) AS gauss FROM (" + _EDGES + ")")
def edge_transforms(spark, d):
    """Edge weights as powers and as a Gaussian."""
    w = F.col("w")
    return vector.edges(_knn(spark, d), EDGE).select("a", "b", "w", F.round(w * w, 6).alias("square"), F.round(w * w * w, 6).alias("cube"), F.round(F.exp(-(1 - w) * (1 - w) / 0.5), 6).alias("gauss"))


@C.query(f"""WITH s AS (SELECT avg(cosine) AS mean, stddev_pop(cosine) AS std, quantile_cont(cosine, 0.98) AS p98 FROM ({_KNN})), n AS (SELECT count(*) AS n FROM embeddings)
    SELECT CAST(greatest(8, least(30, round(3.8 * log10(n)))) AS INTEGER) AS k, round(mean, 5) AS mean, round(std, 5) AS std, round(p98, 5) AS p98, round(greatest(0, least(0.999, mean - 3.2 * std)), 5) AS threshold,
           round(greatest(0.8, least(0.995, p98)), 5) AS dup_threshold, CAST(greatest(5, round(0.011 * n)) AS INTEGER) AS min_theme FROM s, n""")
def derived_defaults(spark, d):
    """Parameters that follow from the neighbour pool."""
    return vector.defaults(_knn(spark, d), read(spark, d, "embeddings").count())


@C.query(f"SELECT src, count(*) AS k, round(sum(cosine), 6) AS total, round(max(cosine), 6) AS top, sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) AS same FROM ({_KNN}) JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst GROUP BY src")
def pool_stats(spark, d):
    """Neighbour pool of each vector, and neighbours of its own theme."""
    labels = read(spark, d, "embeddings").select("vec_id", "label")
    rows = _knn(spark, d).join(labels.select(F.col("vec_id").alias("src"), F.col("label").alias("la")), "src").join(labels.select(F.col("vec_id").alias("dst"), F.col("label").alias("lb")), "dst")
    return rows.groupBy("src").agg(F.count("*").alias("k"), F.round(F.sum("cosine"), 6).alias("total"), F.round(F.max("cosine"), 6).alias("top"), F.count_if(F.col("la") == F.col("lb")).alias("same"))


@C.query(f"""WITH k AS ({_KNN}), a AS (SELECT src, list(dst) AS x FROM k WHERE rank <= 5 GROUP BY 1), b AS (SELECT src, list(dst) AS y FROM k WHERE rank >= 4 GROUP BY 1)
    SELECT src, round(len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM a JOIN b USING (src)""")
def neighbour_jaccard(spark, d):
    """Overlap of two neighbour lists (here the near and the far part of one)."""
    part = lambda bound: F.collect_list(F.when(F.expr(bound), F.col("dst")))
    lists = _knn(spark, d).groupBy("src").agg(part("rank <= 5").alias("x"), part("rank >= 4").alias("y"))
    return lists.where((F.size("x") > 0) & (F.size("y") > 0)).select("src", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


_DUP = f"""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    WHERE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) >= {DUP}"""


@C.query(f"""WITH RECURSIVE l AS ({_DUP}), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY node)
    SELECT component, count(*) AS weight FROM c GROUP BY component""")
def near_dup_groups(spark, d):
    """Groups of vectors linked by a cosine above the bound, with their representative and weight."""
    links = vector.pairs(read(spark, d, "embeddings"), "vec_id", "embedding", least=DUP).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return closure.components(checkpointed(links), checkpointed).groupBy("component").agg(F.count("*").alias("weight"))


@C.query(f"""WITH l AS (SELECT a.label, count(*) AS dup FROM ({_DUP}) p JOIN embeddings a ON a.vec_id = p.a JOIN embeddings b ON b.vec_id = p.b WHERE a.label = b.label GROUP BY 1), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT label, n, round(1 - coalesce(dup, 0) / (n * (n - 1) / 2.0), 6) AS diversity FROM c LEFT JOIN l USING (label)""")
def cluster_diversity(spark, d):
    """Share of a theme's pairs that are no near duplicates."""
    vs = read(spark, d, "embeddings")
    labels = vs.select("vec_id", "label")
    pairs = vector.pairs(vs, "vec_id", "embedding", least=DUP).where("src < dst")
    same = pairs.join(labels.withColumnRenamed("vec_id", "src"), "src").join(labels.select(F.col("vec_id").alias("dst"), F.col("label").alias("lb")), "dst").where("label = lb").groupBy("label").agg(F.count("*").alias("dup"))
    n = F.col("n")
    return labels.groupBy("label").agg(F.count("*").alias("n")).join(same, "label", "left").select("label", "n", F.round(1 - F.coalesce("dup", F.lit(0)) / (n * (n - 1) / 2), 6).alias("diversity"))


@C.query(f"""WITH e AS ({_EDGES}), x AS (SELECT a.label AS la, b.label AS lb, w FROM e JOIN embeddings a ON a.vec_id = e.a JOIN embeddings b ON b.vec_id = e.b), m AS (SELECT sum(w) AS m, sum(CASE WHEN la = lb THEN w ELSE 0 END) AS i FROM x),
    g AS (SELECT label, sum(w) AS deg FROM (SELECT la AS label, w FROM x UNION ALL SELECT lb, w FROM x) GROUP BY 1) SELECT round(max(i / m) - sum((deg / (2 * m)) ** 2), 6) AS modularity FROM g, m""")
def modularity_of_labels(spark, d):
    """Modularity of the given themes on the neighbour graph."""
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "label")
    return vector.modularity(vector.edges(_knn(spark, d), EDGE), labels)


@C.query(f"""WITH e AS ({_EDGES}), x AS (SELECT a.label AS la, b.label AS lb, w FROM e JOIN embeddings a ON a.vec_id = e.a JOIN embeddings b ON b.vec_id = e.b), s AS (SELECT la, lb, sum(w) AS w FROM (SELECT la, lb, w FROM x UNION ALL SELECT lb, la, w FROM x) GROUP BY 1, 2)
    SELECT la, lb, round(w / sum(w) OVER (PARTITION BY la), 6) AS affinity FROM s""")
def leaf_affinity(spark, d):
    """Where the neighbours of each theme lie."""
    labels = read(spark, d, "embeddings").select("vec_id", "label")
    e = vector.edges(_knn(spark, d), EDGE).join(labels.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    sums = e.select("la", "lb", "w").union(e.select("lb", "la", "w")).groupBy("la", "lb").agg(F.sum("w").alias("w"))
    whole = sums.groupBy("la").agg(F.sum("w").alias("t"))
    return sums.join(whole, "la").select("la", "lb", F.round(F.col("w") / F.col("t"), 6).alias("affinity"))


@C.query("WITH c AS (" + _CARDS.format(t="embeddings") + f"""), l AS (SELECT a.label, count(*) AS dup FROM ({_DUP}) p JOIN embeddings a ON a.vec_id = p.a JOIN embeddings b ON b.vec_id = p.b WHERE a.label = b.label GROUP BY 1),
    d AS (SELECT c.*, round(1 - coalesce(dup, 0) / (n * (n - 1) / 2.0), 6) AS diversity FROM c LEFT JOIN l USING (label)), s AS (SELECT label, round(n * (0.5 + greatest(0, consensus) * greatest(0, coalesce(diversity, 1))), 6) AS interest, round(n * greatest(consensus, 0), 6) AS flat FROM d)
    SELECT label, interest, CAST(row_number() OVER (ORDER BY interest DESC, label) AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY flat DESC, label) AS INTEGER) AS flat_rank FROM s""")
def theme_rank(spark, d):
    """Themes by interest (weight times quality) and by weight times agreement."""
    cards = theme_cards(spark, d).join(cluster_diversity(spark, d).select("label", "diversity"), "label")
    positive = lambda c: F.greatest(F.lit(0.0), c)
    interest = F.round(F.col("n") * (0.5 + positive(F.col("consensus")) * positive(F.coalesce("diversity", F.lit(1.0)))), 6)
    rows = cards.select("label", interest.alias("interest"), F.round(F.col("n") * positive(F.col("consensus")), 6).alias("flat"))
    place = lambda c: F.row_number().over(W.orderBy(F.desc(c), "label"))  # noqa: E731 one row a theme
    return rows.select("label", "interest", place("interest").alias("rank"), place("flat").alias("flat_rank"))


@C.query()
def communities(spark, d):
    """Communities of the neighbour graph at resolution 1 (iterative, so without SQL)."""
    return community.communities(vector.edges(_knn(spark, d), EDGE), 1.0, checkpointed)


@C.query()
def live_recluster(spark, d):
    """The graph clustered anew at other parameters, as theme cards of the communities."""
    vs = read(spark, d, "embeddings")
    labels = community.communities(vector.edges(vector.pairs(vs, "vec_id", "embedding", 6), 0.3), 1.0, checkpointed)
    return node_stats.theme_cards(vs.select("vec_id", "embedding").join(labels, F.col("vec_id") == F.col("node")).select("label", "embedding"), "label", "embedding")


@C.query()
def gamma_sweep(spark, d):
    """Communities and modularity at each resolution, with a mark at the one that is kept (iterative, so without SQL)."""
    return community.sweep(checkpointed(vector.edges(_knn(spark, d), EDGE)), checkpointed)[0]


@C.query()
def two_level_communities(spark, d):
    """Macro communities and the leaves inside them, crumbs joined to the nearest leaf (iterative, so without SQL)."""
    links = checkpointed(vector.edges(_knn(spark, d), EDGE))
    return community.two_level(links, read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector")), checkpointed, 0.7, 1.4)


@C.query()
def root_coarsening(spark, d):
    """Themes merged to coarser roots (sequential over at most 512 sums, so without SQL)."""
    return coarsen.roots(read(spark, d, "embeddings"), "label", "embedding")


@C.query()
def threshold_sweep(spark, d):
    """Communities and their modularity at several edge thresholds (iterative, so without SQL)."""
    near, bounds = checkpointed(_knn(spark, d)), (0.25, 0.3, 0.35)
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("run"), F.lit(t).alias("threshold")) for k, t in enumerate(bounds))))
    graphs = vector.edges(near, bounds[0]).select("a", "b", "w", each.alias("r")).where("w >= r.threshold").select("r.run", "a", "b", "w", F.lit(1.0).alias("gamma"))
    found = community.modularities(graphs, community.partition(graphs, checkpointed))
    return found.select("modularity", F.col("n_communities").alias("communities"), F.element_at(F.array(*map(F.lit, bounds)), F.col("run").cast("int") + 1).alias("threshold"))


@C.query("SELECT count(*) AS before, sum(CASE WHEN c >= 0.2 THEN 1 ELSE 0 END) AS correlated, round(max(c), 6) AS top FROM (SELECT round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id > 0)")
def submission_correlation(spark, d):
    """One submission against all before it: only aggregates leave."""
    vs = read(spark, d, "embeddings")
    one = vs.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    sim = F.round(vector.dot(F.col("embedding"), F.col("q")), 6)
    return vs.where("vec_id > 0").join(F.broadcast(one)).select(sim.alias("c")).agg(F.count("*").alias("before"), F.count_if(F.col("c") >= 0.2).alias("correlated"), F.round(F.max("c"), 6).alias("top"))


QUERIES, ORACLES = C.queries, C.oracles
