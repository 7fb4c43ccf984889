"""Opinion, demographics, indices, trees and serving.

Stand-ins: a document's label is its stance (good quality: favour, bad: against, none: nuanced), its source a leaf
theme, its language the macro theme above; nations under regions are a second tree; customers are respondents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import claims as claims_of
from ..operators import opinion, serve, spans, tree
from .base import Catalogue, read

C = Catalogue()
_CLAIMS = """SELECT doc_id, source AS theme, lang, text, n_chars, CASE quality WHEN 1 THEN 'favour' WHEN 0 THEN 'against' ELSE 'nuanced' END AS stance, toxic
    FROM documents LEFT JOIN labels USING (doc_id)"""
_SPLIT = "count(*) AS n, count(*) FILTER (stance = 'favour') AS favour, count(*) FILTER (stance = 'against') AS against, count(*) FILTER (stance = 'nuanced') AS nuanced"
_SCORED = """*, round((favour + against) / n, 3) AS engagement, round(coalesce(least(favour, against) / nullif(favour + against, 0), 0), 3) AS opposition,
    round(coalesce(favour / nullif(favour + against, 0), 0), 3) AS pct_favour,
    CASE WHEN n < 8 OR (favour + against) / n < 0.35 THEN 'unclear' WHEN least(favour, against) / (favour + against) >= 0.15 THEN 'divided' ELSE 'consensual' END AS profile"""


def claims(spark, d):
    stance = F.when(F.col("quality") == 1, "favour").when(F.col("quality") == 0, "against").otherwise("nuanced")
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("source").alias("theme"), "lang", "text", "n_chars", stance.alias("stance"), "toxic")


@C.query(f"SELECT {_SCORED} FROM (SELECT theme, {_SPLIT} FROM ({_CLAIMS}) GROUP BY theme)")
def opinion_split(spark, d):
    """For and against in each theme, with the profile."""
    return opinion.scored(opinion.split(claims(spark, d), "theme", "stance"))


@C.query(f"SELECT profile, count(*) AS themes FROM (SELECT {_SCORED} FROM (SELECT theme || '/' || lang AS theme, {_SPLIT} FROM ({_CLAIMS}) GROUP BY 1)) GROUP BY profile")
def opinion_counts(spark, d):
    """Themes of each profile, by theme and language."""
    leaf = claims(spark, d).withColumn("theme", F.concat("theme", F.lit("/"), "lang"))
    return opinion.scored(opinion.split(leaf, "theme", "stance")).groupBy("profile").agg(F.count("*").alias("themes"))


@C.query(f"""WITH l AS (SELECT {_SCORED} FROM (SELECT lang || '/' || theme AS theme, lang, {_SPLIT} FROM ({_CLAIMS}) GROUP BY 1, 2))
    SELECT {_SCORED} FROM (SELECT lang AS ancestor, CAST(sum(n) AS BIGINT) AS n, CAST(sum(favour) AS BIGINT) AS favour, CAST(sum(against) AS BIGINT) AS against, CAST(sum(nuanced) AS BIGINT) AS nuanced FROM l WHERE profile <> 'unclear' GROUP BY lang)""")
def opinion_rollup(spark, d):
    """Macro themes from their clear leaves."""
    leaf = claims(spark, d).withColumn("theme", F.concat("lang", F.lit("/"), "theme"))
    clear = opinion.scored(opinion.split(leaf, "theme", "stance")).where("profile != 'unclear'")
    bridge = leaf.select("theme", F.col("lang").alias("ancestor")).distinct()
    return opinion.scored(opinion.roll_up(clear.select("theme", "n", "favour", "against", "nuanced"), bridge, "theme", ["n", "favour", "against", "nuanced"]))


@C.query(f"SELECT theme, doc_id, stance, CASE WHEN toxic = 1 THEN 'low' WHEN toxic = 0 THEN 'high' ELSE 'low' END AS confidence FROM ({_CLAIMS}) WHERE theme IN (SELECT theme FROM (SELECT {_SCORED} FROM (SELECT theme, {_SPLIT} FROM ({_CLAIMS}) GROUP BY theme)) WHERE profile <> 'unclear')")
def claim_stances(spark, d):
    """Stances of the claims of clear themes, with a normalised confidence."""
    rows = claims(spark, d)
    clear = opinion.scored(opinion.split(rows, "theme", "stance")).where("profile != 'unclear'").select("theme")
    return rows.join(clear, "theme", "left_semi").select("theme", "doc_id", "stance", F.when(F.col("toxic") == 0, "high").otherwise("low").alias("confidence"))


_GINI = """WITH w AS ({w}), t AS (SELECT count(*) AS n, sum(w) AS total, max(w) AS top FROM w), r AS (SELECT w, row_number() OVER (ORDER BY w) AS r FROM w)
    SELECT n, round(CASE WHEN n > 1 THEN h / ln(n) ELSE 1 END, 6) AS evenness, round(exp(h), 4) AS effective, round(top / total, 6) AS top_share, round(2 * s / (n * total) - (n + 1) / n, 6) AS gini
    FROM t, (SELECT sum(-(w / total) * ln(w / total)) AS h FROM w, t), (SELECT sum(r * w) AS s FROM r)"""


@C.query(_GINI.format(w="SELECT CAST(count(*) AS DOUBLE) AS w FROM documents GROUP BY source, lang"))
def dataset_indices(spark, d):
    """Evenness, effective number, top share and Gini of the themes."""
    sizes = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("w"))
    return opinion.concentration(sizes, "w", "source")


@C.query(_GINI.format(w="SELECT CAST(count(*) AS DOUBLE) AS w FROM orders GROUP BY o_custkey"))
def gini_weights(spark, d):
    """The same indices for participation: orders by customer."""
    return opinion.concentration(read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("w")), "w", "o_custkey")


@C.query("SELECT round(least(1.0, sum(CASE WHEN source <> 'src0' THEN 1 ELSE 0 END) / count(*)), 4) AS coverage, count(DISTINCT doc_id) AS total FROM documents")
def coverage_index(spark, d):
    """Share of contributions in themes other than noise (one source stands for noise)."""
    return read(spark, d, "documents").agg(F.round(F.least(F.lit(1.0), F.avg(F.when(F.col("source") != "src0", 1.0).otherwise(0.0))), 4).alias("coverage"), F.count_distinct("doc_id").alias("total"))


@C.query("""SELECT lang, count(*) AS n, round(avg(CASE WHEN left(text, h) || ' ' || substr(text, h + 1) = CASE WHEN doc_id % 10 = 0 THEN upper(left(text, h)) ELSE left(text, h) END || ' ' || substr(text, h + 1) THEN 1.0 ELSE 0.0 END), 4) AS fidelity
    FROM (SELECT doc_id, lang, text, length(text) // 2 AS h FROM documents) GROUP BY lang""")
def fidelity_index(spark, d):
    """Share of claims whose spans, the two halves of the text, rebuild them (every tenth is altered here)."""
    size, half = F.length("text"), F.expr("length(text) div 2")
    head, tail = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    claim = F.concat(F.when(F.col("doc_id") % 10 == 0, F.upper(head)).otherwise(head), F.lit(" "), tail)
    rebuilt = spans.rebuild(F.col("text"), F.array(claims_of.span(F.lit(0), half), claims_of.span(half, size)))
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((rebuilt == claim).cast("double")), 4).alias("fidelity"))


@C.query("SELECT axis, value, count(*) AS n FROM (SELECT 'c_mktsegment' AS axis, c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY 1, 2")
def demographic_counts(spark, d):
    """Respondents by axis and value."""
    return opinion.counts(read(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@C.query("""WITH p AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r, sum(n) OVER (PARTITION BY c_nationkey) AS t FROM p)
    SELECT c_nationkey, c_mktsegment AS majority, n, round(n / t, 4) AS share FROM r WHERE r = 1""")
def demographic_majority(spark, d):
    """Majority segment of each nation, ties by name."""
    return opinion.majority(read(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@C.query("SELECT c_custkey, c_nationkey, count(*) AS avis FROM (SELECT CAST(regexp_extract('survey:' || o_custkey || ':col', ':([0-9]+):', 1) AS BIGINT) AS row_no FROM orders) JOIN customer ON row_no = c_custkey GROUP BY 1, 2")
def row_ordinal_join(spark, d):
    """Contributions joined to export rows by the row number in their id."""
    key = F.concat(F.lit("survey:"), F.col("o_custkey").cast("string"), F.lit(":col"))
    rows = read(spark, d, "orders").select(F.regexp_extract(key, ":([0-9]+):", 1).cast("bigint").alias("c_custkey"))
    return rows.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy("c_custkey", "c_nationkey").agg(F.count("*").alias("avis"))


@C.query("SELECT n_nationkey + 100 AS node, n_regionkey AS ancestor, 1 AS distance FROM nation UNION ALL SELECT n_nationkey + 100, n_nationkey + 100, 0 FROM nation UNION ALL SELECT r_regionkey, r_regionkey, 0 FROM region")
def theme_ancestors(spark, d):
    """Every node of the tree with itself and all above."""
    return tree.ancestors(_nodes(spark, d), "id", "parent_id")


def _nodes(spark, d):
    regions = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("title"))
    return regions.unionByName(read(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("title")))


@C.query("SELECT 3 AS node UNION ALL SELECT n_nationkey + 100 FROM nation WHERE n_regionkey = 3")
def theme_descendants(spark, d):
    """A node and all below."""
    return tree.descendants(_nodes(spark, d), "id", "parent_id", 3)


@C.query("SELECT r_regionkey AS node, r_regionkey AS root FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation")
def theme_roots_of(spark, d):
    """The macro theme of each node."""
    return tree.roots(_nodes(spark, d), "id", "parent_id")


@C.query("""SELECT 'lost member' AS problem, c_nationkey + 200 AS node FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT 'missing parent', 77 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'cycle', n_nationkey + 100 FROM nation WHERE n_regionkey IN (0, 2) UNION ALL SELECT 'cycle', r_regionkey FROM region WHERE r_regionkey IN (0, 2)""")
def tree_violations(spark, d):
    """The tree of nations with broken parents, and all customers, a fifth of them under nodes that do not exist: region 1 is replaced by a missing one, regions 0 and 2 lie under each other."""
    top = F.when(F.col("id") == 0, 2).when(F.col("id") == 2, 0).otherwise(F.when(F.col("parent_id") == 1, 77).otherwise(F.col("parent_id")))
    members = read(spark, d, "customer").select((F.col("c_nationkey") + F.when(F.col("c_custkey") % 5 == 0, 200).otherwise(100)).alias("m"))
    return tree.violations(_nodes(spark, d).withColumn("parent_id", top), members, "id", "parent_id", "m")


def _weighted(spark, d):
    """The tree with the customers below each node as its weight."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    placed = read(spark, d, "customer").select("c_nationkey").join(nations, "c_nationkey")
    counts = placed.select(F.explode(F.array(F.col("c_nationkey") + 100, F.col("n_regionkey"))).alias("id")).groupBy("id").agg(F.count("*").alias("weight"))
    return _nodes(spark, d).join(counts, "id", "left").select("id", "parent_id", F.coalesce("weight", F.lit(0)).alias("weight"))


@C.query("""WITH w AS (SELECT n_nationkey + 100 AS id, n_regionkey AS p, count(c_custkey) AS weight FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT r_regionkey AS id, coalesce(sum(weight), 0) AS weight FROM region LEFT JOIN w ON p = r_regionkey GROUP BY 1),
    x AS (SELECT id, row_number() OVER (ORDER BY weight DESC, id) AS a FROM r), y AS (SELECT w.id, x.a, row_number() OVER (PARTITION BY p ORDER BY weight DESC, w.id) AS b FROM w JOIN x ON x.id = p), z AS (SELECT id, a, 0 AS b, 0 AS depth FROM x UNION ALL SELECT id, a, b, 1 FROM y)
    SELECT id AS node, 'n' || (row_number() OVER (ORDER BY a, b) - 1) AS id, depth FROM z""")
def theme_order(spark, d):
    """Ids of themes in a walk of the tree, the heavier first."""
    return tree.preorder(_weighted(spark, d), "id", "parent_id", "weight")


@C.query("""WITH m AS (SELECT n_nationkey + 100 AS id, n_regionkey AS p, o_orderpriority AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT id AS node, count(DISTINCT o) AS n FROM m GROUP BY 1 UNION ALL SELECT p, count(DISTINCT o) FROM m GROUP BY 1),
    t AS (SELECT r_regionkey AS node FROM region UNION ALL SELECT n_nationkey + 100 FROM nation) SELECT node, coalesce(n, 0) AS n FROM t LEFT JOIN c USING (node)""")
def distinct_below(spark, d):
    """Different contributors (order priorities) of each theme and all below it."""
    members = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_nationkey") + 100).alias("m"), F.col("o_orderpriority").alias("o"))
    return tree.distinct_below(_nodes(spark, d), members, "id", "parent_id", "m", "o")


@C.query("""SELECT r_regionkey AS node, r_name AS path FROM region UNION ALL SELECT n_nationkey + 100, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def tree_preorder(spark, d):
    """Paths whose order is the tree's preorder."""
    nodes = _nodes(spark, d)
    up = tree.ancestors(nodes, "id", "parent_id").join(nodes.select(F.col("id").alias("ancestor"), "title"), "ancestor")
    return up.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), "title"))), lambda x: x["title"]), "/").alias("path"))


_FOLD = "replace(strip_accents(lower(text)), 'ß', 'ss')"


def _avis(spark, d):
    rows = claims(spark, d)
    return rows.select(F.col("doc_id").alias("rank"), "lang", "theme", "stance", "text", text.fold("text").alias("folded"))


@C.query("SELECT doc_id AS rank, lang FROM documents ORDER BY doc_id LIMIT 15 OFFSET 30")
def search_plain(spark, d):
    """A page of all contributions."""
    return serve.page(read(spark, d, "documents").select(F.col("doc_id").alias("rank"), "lang"), ["rank"], 15, 30)


@C.query(f"SELECT doc_id AS rank FROM documents WHERE contains({_FOLD}, 'entre')")
def search_fold(spark, d):
    """Contributions that hold a needle, whatever accents and case."""
    a = _avis(spark, d)
    return serve.search(a, a, needle="entre").select("rank")


@C.query("SELECT c_custkey AS rank FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def search_subtree(spark, d):
    """Respondents under a node of the tree."""
    themes = tree.descendants(_nodes(spark, d), "id", "parent_id", 2).select(F.col("node").alias("theme"))
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("rank"), (F.col("c_nationkey") + 100).alias("theme"))
    return serve.search(people.select("rank"), people, themes)


@C.query(f"SELECT doc_id AS rank FROM ({_CLAIMS}) WHERE theme IN ('src1', 'src2') AND stance = 'against'")
def search_stance_same_row(spark, d):
    """Theme and stance on one claim."""
    a = _avis(spark, d)
    themes = spark.createDataFrame([("src1",), ("src2",)], "theme string")
    return serve.search(a.select("rank"), a, themes, stance="against")


_COMBINED = f"SELECT doc_id AS rank FROM ({_CLAIMS}) WHERE theme IN ('src1', 'src2', 'src3') AND stance = 'favour' AND contains({_FOLD}, 'est')"


@C.query(_COMBINED)
def search_combined(spark, d):
    """Theme, stance and needle together."""
    a = _avis(spark, d)
    themes = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "theme string")
    return serve.search(a.select("rank", "folded"), a, themes, "est", stance="favour").select("rank")


@C.query(f"SELECT (SELECT count(*) FROM ({_COMBINED})) AS total, rank FROM ({_COMBINED}) ORDER BY rank LIMIT 5")
def search_page_total(spark, d):
    """A page with the total of all pages."""
    found = search_combined(spark, d)
    return serve.page(found, ["rank"], 5, 0).crossJoin(F.broadcast(found.agg(F.count("*").alias("total")))).select("total", "rank")


@C.query(f"SELECT doc_id, theme, lang, stance, substr(text, 1, 80) AS excerpt FROM ({_CLAIMS})")
def detail_with_stance(spark, d):
    """Detail rows with the stance joined late."""
    rows = read(spark, d, "documents")
    stance = F.when(F.col("quality") == 1, "favour").when(F.col("quality") == 0, "against").otherwise("nuanced")
    return rows.join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("source").alias("theme"), "lang", stance.alias("stance"), F.substring("text", 1, 80).alias("excerpt"))


QUERIES, ORACLES = C.queries, C.oracles
