"""Evaluation, co-occurrence, spans, arguments and segmentation.

Stand-ins: labels are predictions and truths, conversations segmented texts, benchmark passages claims of documents,
orders contributions whose parts' brands are themes.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import claims, evaluate, spans, vector
from .base import Catalogue, read
from .claims import _NUMBERED as NUMBERED
from .claims import _start as span_start

C = Catalogue()
_CLUSTER = """WITH t AS (SELECT {p} AS pred, {t} AS truth, count(*) AS n FROM {f} GROUP BY 1, 2), a AS (SELECT pred, sum(n) AS n, max(n) AS m FROM t GROUP BY 1), b AS (SELECT truth, sum(n) AS n FROM t GROUP BY 1), x AS (SELECT sum(n) AS total FROM t),
    s AS (SELECT (SELECT -sum(n / total * ln(n / total)) FROM t, x) AS hb, (SELECT -sum(n / total * ln(n / total)) FROM a, x) AS hp, (SELECT -sum(n / total * ln(n / total)) FROM b, x) AS ht,
          (SELECT sum(n * (n - 1) / 2) FROM t) AS pb, (SELECT sum(n * (n - 1) / 2) FROM a) AS pp, (SELECT sum(n * (n - 1) / 2) FROM b) AS pt, (SELECT sum(m) / sum(n) FROM a) AS purity, total FROM x),
    m AS (SELECT *, hp + ht - hb AS i, pp * pt / (total * (total - 1) / 2) AS e FROM s)
    SELECT round(purity, 6) AS purity, round(i / ((hp + ht) / 2), 6) AS nmi, round((pb - e) / ((pp + pt) / 2 - e), 6) AS ari, round(i / ht, 6) AS homogeneity, round(i / hp, 6) AS completeness,
           round(2 * (i / ht) * (i / hp) / (i / ht + i / hp), 6) AS v_measure FROM m"""


@C.query(_CLUSTER.format(p="lang", t="source", f="documents"))
def clustering_scores(spark, d):
    """Purity, NMI, ARI and V-measure of languages against sources."""
    return evaluate.clustering(read(spark, d, "documents"), "lang", "source")


@C.query(_CLUSTER.format(p="c_mktsegment", t="c_nationkey % 5", f="customer"))
def clustering_scores_customers(spark, d):
    """The same scores of segments against nations."""
    return evaluate.clustering(read(spark, d, "customer").withColumn("truth", F.col("c_nationkey") % 5), "c_mktsegment", "truth")


_JUDGED = "SELECT d.lang, CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars > 300 THEN 1 ELSE 0 END AS pred, l.quality AS truth FROM documents d JOIN labels l USING (doc_id)"


def _judged(spark, d):
    pred = F.when(F.col("n_chars") % 5 == 0, F.lit(None).cast("int")).when(F.col("n_chars") > 300, 1).otherwise(0)
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("lang", pred.alias("pred"), F.col("quality").alias("truth"))


@C.query(f"""WITH j AS ({_JUDGED}), s AS (SELECT count(*) FILTER (pred = 1 AND truth = 1) AS tp, count(*) FILTER (pred = 1 AND truth <> 1) AS fp, count(*) FILTER (pred = 0 AND truth = 1) AS fn, count(*) FILTER (pred = 0 AND truth <> 1) AS tn, count(*) FILTER (pred IS NULL) AS undecided, count(*) AS n FROM j)
    SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round(undecided / n, 6) AS abstention FROM s""")
def confusion(spark, d):
    """Scores of a length rule with abstention against the labels."""
    return evaluate.classification(_judged(spark, d), "pred", "truth", 1)


@C.query("SELECT quality, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS clean, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY quality")
def confusion_matrix(spark, d):
    """Two labels against each other."""
    return read(spark, d, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@C.query("""WITH x AS (SELECT doc_id, quality = 1 AS a, toxic = 1 AS b FROM labels), y AS (SELECT doc_id, n_chars > 300 AS a, n_chars % 7 = 0 AS b FROM documents), t AS (SELECT doc_id, 'good' AS l, x.a AS t, y.a AS p FROM x JOIN y USING (doc_id) UNION ALL SELECT doc_id, 'toxic', x.b, y.b FROM x JOIN y USING (doc_id)),
    s AS (SELECT l, sum(CASE WHEN t AND p THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND NOT t THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN t AND NOT p THEN 1 ELSE 0 END) AS fn FROM t GROUP BY l)
    SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro, (SELECT count(*) FROM (SELECT doc_id FROM t GROUP BY 1 HAVING bool_and(t = p))) AS exact FROM s""")
def multilabel_f1(spark, d):
    """Micro and macro F1 and exact sets over two labels."""
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    cells = F.array(F.struct(F.lit("good").alias("l"), (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 300).alias("p")), F.struct(F.lit("toxic").alias("l"), (F.col("toxic") == 1).alias("t"), (F.col("n_chars") % 7 == 0).alias("p")))
    long = rows.select("doc_id", F.explode(cells).alias("c")).select("doc_id", "c.*")
    s = long.groupBy("l").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    exact = long.groupBy("doc_id").agg(F.bool_and(F.col("t") == F.col("p")).alias("same")).agg(F.count_if("same").alias("exact"))
    f1 = s.agg(F.round(2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), 6).alias("micro"), F.round(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))), 6).alias("macro"))
    return f1.crossJoin(exact)


@C.query("SELECT round((b - s * s / n) / (q - s * s / n), 6) AS eta_squared FROM (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM (SELECT source, count(*) AS n, sum(n_chars)::DOUBLE AS s, sum(n_chars::DOUBLE * n_chars) AS q FROM documents GROUP BY 1))")
def eta_squared(spark, d):
    """Variance of lengths explained by the source."""
    return evaluate.eta_squared(read(spark, d, "documents"), "source", "n_chars")


@C.query("SELECT lang, count(*) AS n, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS p75, quantile_cont(n_chars, 0.9) AS p90, max(n_chars) AS max, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS std FROM documents GROUP BY lang")
def quantile_summary(spark, d):
    """Distribution of lengths by language."""
    q = lambda p: F.percentile("n_chars", p)
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), q(0.9).alias("p90"), F.max("n_chars").alias("max"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.stddev_pop("n_chars"), 4).alias("std"))


@C.query("""WITH t AS (SELECT lang, doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda t: t IN ('the', 'and', 'der', 'die', 'les', 'des', 'los', 'las', 'that', 'und')))) AS term FROM documents), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
    f AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2), p AS (SELECT a.lang, a.term AS x, b.term AS y, count(*) AS c FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2, 3)
    SELECT p.lang, x, y, p.c AS n_both, round(CASE WHEN p.c = n THEN 1 ELSE ln(p.c * 1.0 * n / (fx.c * fy.c)) / -ln(p.c * 1.0 / n) END, 6) AS npmi FROM p JOIN n USING (lang) JOIN f fx ON fx.lang = p.lang AND fx.term = x JOIN f fy ON fy.lang = p.lang AND fy.term = y""")
def npmi(spark, d):
    """Coherence of given terms by language."""
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1), lambda t: t.isin("the", "and", "der", "die", "les", "des", "los", "las", "that", "und")))
    docs = read(spark, d, "documents").select("lang", F.array_sort(terms).alias("ts"))
    n = docs.groupBy("lang").agg(F.count("*").alias("n"))
    f = docs.select("lang", F.explode("ts").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("c"))
    firsts = docs.select("lang", "ts", F.posexplode("ts").alias("i", "x"))
    p = firsts.select("lang", "x", F.explode(F.slice("ts", F.col("i") + 2, 10)).alias("y")).groupBy("lang", "x", "y").agg(F.count("*").alias("n_both"))
    rows = p.join(n, "lang").join(f.select("lang", F.col("term").alias("x"), F.col("c").alias("cx")), ["lang", "x"]).join(f.select("lang", F.col("term").alias("y"), F.col("c").alias("cy")), ["lang", "y"])
    value = F.log(F.col("n_both") * F.col("n") / (F.col("cx") * F.col("cy"))) / -F.log(F.col("n_both") / F.col("n"))
    return rows.select("lang", "x", "y", "n_both", F.round(F.when(F.col("n_both") == F.col("n"), 1.0).otherwise(value), 6).alias("npmi"))


@C.query("""WITH d AS (SELECT l_shipmode_w AS w, l_shipmode_l AS l FROM (SELECT 'v' || (l_partkey % 5) AS l_shipmode_w, 'v' || (l_suppkey % 5) AS l_shipmode_l FROM lineitem) WHERE l_shipmode_w <> l_shipmode_l), c AS (SELECT w, l, count(*) AS n FROM d GROUP BY 1, 2),
    b AS (SELECT coalesce(a.w, b.l) AS x, coalesce(a.l, b.w) AS y, sign(coalesce(a.n, 0) - coalesce(b.n, 0)) AS s FROM c a FULL JOIN c b ON a.w = b.l AND a.l = b.w)
    SELECT x AS name, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) AS losses, CAST(sum(s) AS BIGINT) AS net FROM b GROUP BY x""")
def copeland(spark, d):
    """Net pairwise wins of variants (part and supplier numbers stand for votes)."""
    v = lambda c: F.concat(F.lit("v"), (F.col(c) % 5).cast("string"))
    return evaluate.copeland(read(spark, d, "lineitem").select(v("l_partkey").alias("w"), v("l_suppkey").alias("l")).where("w != l"), "w", "l")


@C.query("""WITH r AS (SELECT source, avg(n_chars) AS size, count(DISTINCT lang) * 1.0 AS langs, sum(CASE WHEN n_chars < 100 THEN 1.0 ELSE 0 END) / count(*) AS short FROM documents GROUP BY 1), x AS (SELECT min(size) AS a, max(size) AS b, min(langs) AS c, max(langs) AS d, min(short) AS e, max(short) AS f FROM r)
    SELECT source, round(coalesce((size - a) / nullif(b - a, 0), 0) * 0.5 + coalesce((langs - c) / nullif(d - c, 0), 0) * 0.25 + (1 - coalesce((short - e) / nullif(f - e, 0), 0)) * 0.25, 6) AS score FROM r, x""")
def composite_score(spark, d):
    """A weighted score of sources from scaled measures."""
    rows = read(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("size"), F.count_distinct("lang").cast("double").alias("langs"), F.avg((F.col("n_chars") < 100).cast("double")).alias("short"))
    return evaluate.composite(rows, "source", {"size": 2.0, "langs": 1.0, "short": -1.0})


@C.query("WITH t AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), m AS (SELECT source, max(n) AS m, sum(n) AS n FROM t GROUP BY 1) SELECT round(sum(m) / sum(n), 6) AS nested FROM m")
def nestedness(spark, d):
    """How far the finer partition nests in the coarser."""
    t = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return t.groupBy("source").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg(F.round(F.sum("m") / F.sum("n"), 6).alias("nested"))


@C.query("""WITH x AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS n FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2""")
def cooccurrence(spark, d):
    """Themes (brands) that meet in contributions (orders)."""
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return evaluate.cooccurrence(read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey"), "l_orderkey", "p_brand")


@C.query("""WITH x AS (SELECT DISTINCT conv_id, role || (turn % 3) AS t, role AS parent FROM conversations) SELECT a.parent, a.t AS a, b.t AS b, count(*) AS n FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.parent = b.parent AND a.t < b.t GROUP BY 1, 2, 3""")
def cooccurrence_siblings(spark, d):
    """Sibling themes that meet, under one parent only."""
    rows = read(spark, d, "conversations").select("conv_id", F.col("role").alias("parent"), F.concat("role", (F.col("turn") % 3).cast("string")).alias("t"))
    sets = rows.groupBy("conv_id", "parent").agg(F.array_sort(F.collect_set("t")).alias("ts")).where(F.size("ts") > 1)
    firsts = sets.select("parent", "ts", F.posexplode("ts").alias("i", "a"))
    return firsts.select("parent", "a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("b")).groupBy("parent", "a", "b").agg(F.count("*").alias("n"))


def _claims(spark, d):
    """Every other line of a document as a claim, anchored in its whole text."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("claim", "l")).where("claim % 2 = 0")
    rows = claims.align(docs, lines.select("doc_id", "claim", F.array("l").alias("parts"), F.lit(None).cast("string").alias("target")), "doc_id")
    return rows.select("doc_id", "claim", "text", "spans", F.col("spans")[0]["start"].alias("start"), F.col("spans")[0]["end"].alias("end"))


_SPANS = f"SELECT doc_id, i, s, s + length(l) AS e, l AS c, text FROM (SELECT *, {span_start('nth')} AS s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) - 1 AS nth FROM ({NUMBERED}) WHERE i % 2 = 0))"
_COVER = f"""SELECT doc_id, min(s) AS start, max(e) AS end FROM (SELECT *, sum(CASE WHEN s > coalesce(m, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM (
    SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({_SPANS}))) GROUP BY doc_id, k"""


@C.query(f"SELECT doc_id, CAST(i AS INTEGER) AS claim, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS end FROM ({_SPANS})")
def span_locate(spark, d):
    """Where claims stand in their contributions."""
    return _claims(spark, d).select("doc_id", "claim", "start", "end")


@C.query(f"SELECT count(*) AS claims, count(*) FILTER (substr(text, s + 1, e - s) = c) AS verbatim FROM ({_SPANS})")
def span_verbatim(spark, d):
    """Claims whose spans give their text."""
    rows = _claims(spark, d).withColumnRenamed("text", "claim_text").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.agg(F.count("*").alias("claims"), F.count_if(spans.rebuild(F.col("text"), F.col("spans")) == F.col("claim_text")).alias("verbatim"))


@C.query(_COVER)
def highlight_cover(spark, d):
    """The fewest intervals that cover the claims of a contribution."""
    return spans.cover(_claims(spark, d).select("doc_id", "start", "end"), "doc_id")


@C.query(f"""WITH c AS ({_COVER}), m AS (SELECT doc_id, start, "end" FROM c UNION ALL SELECT DISTINCT doc_id, -1, 0 FROM c UNION ALL SELECT doc_id, length(text), length(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM c)),
    n AS (SELECT doc_id, "end" AS a, lead(start) OVER (PARTITION BY doc_id ORDER BY start, "end") AS b FROM m) SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS end FROM n WHERE b - a >= 50""")
def uncovered_segments(spark, d):
    """Stretches of 50 characters or more that no claim covers."""
    sizes = read(spark, d, "documents").select("doc_id", F.length("text").alias("n_chars"))
    return spans.uncovered(_claims(spark, d).select("doc_id", "start", "end").join(sizes, "doc_id"), "doc_id", "n_chars", 50)


_BOUND = "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS ref, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS hyp FROM conversations"


def _bounds(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 1).otherwise(0).alias("ref"), F.when(F.col("turn") % 2 == 0, 1).otherwise(0).alias("hyp"))


@C.query(f"SELECT conv_id, turn, CAST(sum(ref) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM ({_BOUND})")
def segment_ids(spark, d):
    """Segments of a conversation, each begun by a user."""
    return evaluate.segments(_bounds(spark, d), "conv_id", "turn", F.col("ref")).select("conv_id", "turn", "segment")


@C.query(f"""WITH b AS ({_BOUND}), s AS (SELECT *, sum(ref) OVER (PARTITION BY conv_id ORDER BY turn) AS r, sum(hyp) OVER (PARTITION BY conv_id ORDER BY turn) AS h, sum(ref) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS rb,
    sum(hyp) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS hb FROM b), l AS (SELECT *, lead(r, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS r2, lead(h, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS h2 FROM s)
    SELECT conv_id, round(avg(CASE WHEN (r = r2) <> (h = h2) THEN 1.0 ELSE 0 END), 6) AS pk, round(avg(CASE WHEN rb <> hb THEN 1.0 ELSE 0 END), 6) AS window_diff FROM l WHERE r2 IS NOT NULL GROUP BY conv_id""")
def pk_window_diff(spark, d):
    """Segmentation errors at a fixed lag."""
    return evaluate.pk_window_diff(_bounds(spark, d), "conv_id", "turn", 2)


@C.query("""SELECT conv_id, turn, round(l, 4) AS left_mean, round(r, 4) AS right_mean, round(m, 4) AS smooth FROM (SELECT conv_id, turn, avg(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l,
    avg(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS r, avg(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM conversations)""")
def block_similarity(spark, d):
    """Left, right and centred window means along a conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    mean = lambda a, b: F.round(F.avg(F.length("text")).over(w.rowsBetween(a, b)), 4)
    return read(spark, d, "conversations").select("conv_id", "turn", mean(-2, -1).alias("left_mean"), mean(0, 1).alias("right_mean"), mean(-1, 1).alias("smooth"))


_ARG = """SELECT vec_id, label, arg FROM (SELECT v.vec_id, v.label, a.vec_id AS arg, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_dot_product(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) DESC, a.vec_id) AS r
    FROM embeddings v JOIN embeddings a ON a.vec_id < 5) WHERE r = 1"""


@C.query(f"SELECT label, arg, count(*) AS support, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM ({_ARG}) GROUP BY label, arg HAVING count(*) >= 1")
def argument_support(spark, d):
    """Each claim with its nearest candidate argument (five at most), and the support of each."""
    from ..operators.vector import dot

    vs = read(spark, d, "embeddings")
    few = vs.where("vec_id < 5").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("args"))
    sims = F.transform("args", lambda a: F.struct(F.round(dot(F.col("embedding"), a["embedding"]), 6).alias("s"), (-a["vec_id"]).alias("i")))
    best = vs.join(F.broadcast(few)).select("label", (-F.array_max(sims)["i"]).alias("arg"))
    counts = best.groupBy("label", "arg").agg(F.count("*").alias("support"))
    return counts.join(best.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "arg", "support", F.round(F.col("support") / F.col("n"), 6).alias("share"))


@C.query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) >= 3) SELECT lang, CAST(sum(n) AS BIGINT) AS support, count(*) AS leaves, max(n) AS largest FROM c GROUP BY lang")
def argument_rollup(spark, d):
    """Support of leaves of three or more summed for their parent."""
    leaves = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).where("n >= 3")
    return leaves.groupBy("lang").agg(F.sum("n").alias("support"), F.count("*").alias("leaves"), F.max("n").alias("largest"))


@C.query("""WITH x AS (SELECT o_custkey, o_orderpriority AS theme, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS t FROM orders GROUP BY 1, 2), s AS (SELECT theme, o_custkey, n, round(n / t * (n / 3.0), 6) AS score FROM x)
    SELECT theme, o_custkey AS hero, score FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY score DESC, o_custkey) AS r FROM s) WHERE r = 1""")
def hero_avis(spark, d):
    """The contribution that stands best for each theme: purity times coverage."""
    x = read(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("theme")).agg(F.count("*").alias("n"))
    t = x.groupBy("o_custkey").agg(F.sum("n").alias("t"))
    s = x.join(t, "o_custkey").withColumn("score", F.round(F.col("n") / F.col("t") * (F.col("n") / 3.0), 6))
    return s.groupBy("theme").agg(F.max_by(F.struct(F.col("o_custkey").alias("hero"), "score"), F.struct("score", -F.col("o_custkey"))).alias("x")).select("theme", "x.hero", "x.score")


@C.query("""WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS pos FROM embeddings), s AS (SELECT label, pos, sum(v) AS s FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(s * s)) AS n FROM s GROUP BY 1),
    c AS (SELECT label, vec_id, round(sum(v * s) / max(n), 6) AS c FROM e JOIN s USING (label, pos) JOIN n USING (label) GROUP BY 1, 2)
    SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) AS r FROM c) WHERE r <= 20""")
def input_cap(spark, d):
    """The members of each theme that a model would read: a bounded number, the nearest to the theme's centroid first."""
    e = read(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    parts = e.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("s"))
    sums = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("total"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("size"))
    near = F.round(vector.dot(F.col("v"), F.col("total")) / F.col("size"), 6)
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("c"), "vec_id"))
    return e.join(sums, "label").select("label", "vec_id", near.alias("c")).withColumn("r", rank).where("r <= 20").select("label", "vec_id")


QUERIES, ORACLES = C.queries, C.oracles
