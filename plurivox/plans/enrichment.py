"""Titles, guards, descriptors, samples, caches and layouts around the analysis."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import titles
from ..operators import arguments, ingest, vector
from .base import Catalogue, read

C = Catalogue()


@C.query(r"""WITH l AS (SELECT doc_id, trim(split_part(ltrim(text), chr(10), 1)) AS t FROM documents), a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '^[\-*#>\d.)\s]+', ''), '(?i)^(title|titre|titel|título)\s*:\s*', ''), '^["''«»“”]+|["''«»“”.]+$', '', 'g') AS t FROM l)
    SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(trim(t), '\s+'), 1, 10), ' ') AS title FROM a""")
def title_cleanup(spark, d):
    """Titles from first lines."""
    return read(spark, d, "documents").select("doc_id", titles.title(F.col("text")).alias("title"))


@C.query("SELECT doc_id, CASE WHEN n_chars % 137 > 120 THEN NULL WHEN n_chars % 137 < 18 THEN 'under 18' WHEN n_chars % 137 < 25 THEN '18-24' WHEN n_chars % 137 < 35 THEN '25-34' WHEN n_chars % 137 < 50 THEN '35-49' WHEN n_chars % 137 < 65 THEN '50-64' ELSE '65 and over' END AS bracket FROM documents")
def age_brackets(spark, d):
    """Brackets of ages (a remainder stands for the age)."""
    return read(spark, d, "documents").select("doc_id", titles.age_bracket(F.col("n_chars") % 137).alias("bracket"))


@C.query("""WITH h AS (SELECT n_nationkey, n_nationkey / 25.0 * 6 AS h FROM nation), s AS (SELECT n_nationkey, CAST(floor(h) AS INTEGER) AS k, h - floor(h) AS f FROM h), c AS (SELECT n_nationkey, k, 0.9 AS v, 0.9 * 0.4 AS p, 0.9 * (1 - 0.6 * f) AS q, 0.9 * (1 - 0.6 * (1 - f)) AS t FROM s)
    SELECT n_nationkey, '#' || lpad(lower(to_hex(CAST(round([v, q, p, p, t, v][k + 1] * 255) AS INTEGER))), 2, '0') || lpad(lower(to_hex(CAST(round([t, v, v, q, p, p][k + 1] * 255) AS INTEGER))), 2, '0') || lpad(lower(to_hex(CAST(round([p, p, t, v, v, q][k + 1] * 255) AS INTEGER))), 2, '0') AS colour FROM c""")
def palette(spark, d):
    """Colours of themes around the wheel."""
    return read(spark, d, "nation").select("n_nationkey", titles.colour(F.col("n_nationkey"), F.lit(25.0)).alias("colour"))


@C.query("SELECT doc_id, substr(text, 1, 120) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END AS excerpt FROM documents")
def excerpt(spark, d):
    """Openings of contributions."""
    return read(spark, d, "documents").select("doc_id", F.concat(F.substring("text", 1, 120), F.when(F.length("text") > 120, "…").otherwise("")).alias("excerpt"))


@C.query("SELECT count(*) AS themes, max(n) AS largest, round(max(n) / sum(n), 6) AS share, count(*) >= 2 AND max(n) / sum(n) > 0.85 AS degenerate FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def degenerate_guard(spark, d):
    """Whether one theme holds nearly everything."""
    sizes = read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return sizes.agg(F.count("*").alias("themes"), F.max("n").alias("largest"), F.round(share, 6).alias("share"), ((F.count("*") >= 2) & (share > 0.85)).alias("degenerate"))


@C.query("SELECT source, count(*) AS n, round(avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END), 6) AS missing, avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END) > 0.05 AS incomplete FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def enrichment_completeness(spark, d):
    """Share of missing enrichments by source (labels stand for them)."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    miss = F.avg(F.col("quality").isNull().cast("double"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(miss, 6).alias("missing"), (miss > 0.05).alias("incomplete"))


@C.query("""WITH l AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), o AS (SELECT source, string_agg(lang, ',' ORDER BY n DESC, lang) AS langs, sum(n) AS n FROM l GROUP BY 1)
    SELECT source, CAST(n AS BIGINT) AS ideas, langs, n >= 50 AS sampled FROM o""")
def descriptors(spark, d):
    """Descriptor of each source: counts, languages by frequency, whether a cap applied."""
    langs = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "lang"))), lambda x: x["lang"])
    return langs.groupBy("source").agg(F.sum("n").alias("ideas"), F.array_join(ordered, ",").alias("langs")).withColumn("sampled", F.col("ideas") >= 50)


@C.query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(source || ':' || doc_id)) AS r FROM documents) WHERE r <= 12")
def stance_sample(spark, d):
    """A seeded sample of each theme: the seed is the theme itself, so neither order nor threads matter."""
    key = F.md5(F.concat_ws(":", "source", "doc_id").cast("binary"))
    return ingest.cap(read(spark, d, "documents").select("source", "doc_id"), "source", [key], 12)


@C.query("SELECT c.conv_id, c.turn, md5(c.text) AS key, CASE WHEN a.key IS NULL THEN 'translate' ELSE 'cached' END AS action FROM conversations c LEFT JOIN (SELECT DISTINCT md5(text) AS key FROM conversations WHERE role = 'assistant' AND length(text) > 20) a ON a.key = md5(c.text)")
def translation_cache(spark, d):
    """Texts that a cache of valid translations covers, and those it does not."""
    rows = read(spark, d, "conversations").withColumn("key", F.md5(F.col("text").cast("binary")))
    cache = rows.where("role = 'assistant' and length(text) > 20").select("key", F.lit(True).alias("hit")).distinct()
    return rows.join(cache, "key", "left").select("conv_id", "turn", "key", F.when(F.col("hit"), "cached").otherwise("translate").alias("action"))


@C.query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source")
def idea_share(spark, d):
    """Share of each theme among its siblings."""
    n = read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("lang").agg(F.sum("n").alias("t")), "lang").select("lang", "source", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@C.query("SELECT source AS slug, lang AS child, count(*) AS ideas, min(doc_id) AS first_id FROM documents WHERE lang IS NOT NULL AND lang <> '' GROUP BY 1, 2")
def child_split(spark, d):
    """A parent split by a property; blank groups are dropped."""
    return read(spark, d, "documents").where("lang is not null and lang != ''").groupBy(F.col("source").alias("slug"), F.col("lang").alias("child")).agg(F.count("*").alias("ideas"), F.min("doc_id").alias("first_id"))


@C.query("SELECT conv_id, array_to_string(list(role ORDER BY first), ' · ') AS label FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def keyword_remap(spark, d):
    """Distinct keywords in first-seen order joined as a label."""
    firsts = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return firsts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]), " · ").alias("label"))


@C.query("SELECT conv_id, count(*) FILTER (role = 'user') AS favour, count(*) FILTER (role = 'assistant') AS against, min(CASE WHEN length(text) > 200 THEN 2 WHEN length(text) > 60 THEN 1 ELSE 0 END) AS least_confidence FROM conversations GROUP BY conv_id")
def avis_stance_tally(spark, d):
    """Stances of a contribution's claims with the least confidence."""
    size = F.length("text")
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("favour"), F.count_if(F.col("role") == "assistant").alias("against"), F.min(F.when(size > 200, 2).when(size > 60, 1).otherwise(0)).alias("least_confidence"))


@C.query("""WITH e AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), m AS (SELECT min(a) AS a0, max(a) - min(a) AS aw, min(b) AS b0, max(b) - min(b) AS bw FROM e),
    p AS (SELECT least(31, CAST(floor((a - a0) / aw * 32) AS INTEGER)) AS x, least(31, CAST(floor((b - b0) / bw * 32) AS INTEGER)) AS y, count(*) AS w FROM e, m GROUP BY 1, 2), g AS (SELECT a.range AS gx, b.range AS gy FROM range(32) a, range(32) b)
    SELECT gx, gy, round(sum(w * exp(-((gx - x) ** 2 + (gy - y) ** 2) / 8.0)), 6) AS height FROM g, p GROUP BY gx, gy""")
def density_grid(spark, d):
    """Heights of a kernel density on a grid over the first two components, from their least to their largest values. Points
    are counted by cell first, so what meets the grid is bounded by the cells, not by the points."""
    e = read(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    least = e.agg(*(f(c).alias(n + c) for c in "ab" for f, n in ((F.min, "low_"), (F.max, "high_")))).first()
    at = lambda c: F.least(F.lit(31), F.floor((F.col(c) - least[f"low_{c}"]) / (least[f"high_{c}"] - least[f"low_{c}"]) * 32).cast("int"))
    if least["low_a"] in (None, least["high_a"]) or least["low_b"] == least["high_b"]:
        at = lambda c: F.lit(0)
    cells = e.groupBy(at("a").alias("x"), at("b").alias("y")).agg(F.count("*").alias("w"))
    axis = F.sequence(F.lit(0), F.lit(31))
    grid = cells.withColumn("gx", F.explode(axis)).withColumn("gy", F.explode(axis))
    kernel = F.exp(-(F.pow(F.col("gx") - F.col("x"), 2) + F.pow(F.col("gy") - F.col("y"), 2)) / 8.0)
    return grid.groupBy("gx", "gy").agg(F.round(F.sum(F.col("w") * kernel), 6).alias("height"))


@C.query("SELECT a.label = b.label AS same, count(*) AS pairs, round(avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS mean FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) WHERE a.vec_id <> b.vec_id GROUP BY 1")
def anisotropy(spark, d):
    """Mean cosine of sampled pairs inside and across themes; the sample is a fixed permutation."""
    vs = read(spark, d, "embeddings")
    n = vs.agg(F.count("*").alias("n"))
    a = vs.crossJoin(F.broadcast(n)).select("vec_id", "label", "embedding", ((F.col("vec_id") * 7 + 3) % F.col("n")).alias("other"))
    b = vs.select(F.col("vec_id").alias("other"), F.col("label").alias("lb"), F.col("embedding").alias("eb"))
    rows = a.join(b, "other").where("vec_id != other").select((F.col("label") == F.col("lb")).alias("same"), vector.dot(F.col("embedding"), F.col("eb")).alias("c"))
    return rows.groupBy("same").agg(F.count("*").alias("pairs"), F.round(F.avg("c"), 5).alias("mean"))


@C.query("SELECT word, df, rank FROM (SELECT word, df, rank() OVER (ORDER BY df DESC) AS rank FROM (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY 1)) WHERE rank <= 50")
def token_ranks(spark, d):
    """Global ranks of the most frequent tokens. The cut is found over frequencies, so no window holds all tokens."""
    words = read(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    levels = df.groupBy("df").agg(F.count("*").alias("c")).orderBy(F.desc("df")).limit(50)
    ranks = levels.select("df", (F.coalesce(F.sum("c").over(W.orderBy(F.desc("df")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).cast("long").alias("rank")).where("rank <= 50")
    return df.join(F.broadcast(ranks), "df").select("word", "df", "rank")


@C.query("""WITH u AS (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), l AS (SELECT label, list({'i': vec_id, 'v': v} ORDER BY vec_id) AS xs FROM u GROUP BY 1),
    k AS (SELECT label, list_reduce(list_concat([list_filter(xs, lambda y: false)], list_transform(xs, lambda y: [y])), lambda a, y: CASE WHEN len(list_filter(a, lambda z: round(list_dot_product(z.v, y[1].v), 6) >= 0.2)) = 0 THEN list_concat(a, y) ELSE a END) AS ks FROM l)
    SELECT label, unnest(ks).i AS vec_id FROM k""")
def candidate_dedup(spark, d):
    """Greedy choice among each theme's vectors in their order: one is kept unless near a kept one."""
    rows = read(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(0).alias("n_support"))
    return arguments.homes(rows, ["label"], 0.2).where("id = home").select("label", F.col("id").alias("vec_id"))


@C.query("SELECT conv_id, count(*) FILTER (ref = 1 AND hyp = 1) AS hit, count(*) FILTER (ref = 1) AS truth, count(*) FILTER (hyp = 1) AS found FROM (SELECT conv_id, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS ref, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS hyp FROM conversations) GROUP BY conv_id")
def boundary_scores(spark, d):
    """Exact boundary hits of a segmentation."""
    ref, hyp = F.col("role") == "user", F.col("turn") % 2 == 0
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(ref & hyp).alias("hit"), F.count_if(ref).alias("truth"), F.count_if(hyp).alias("found"))


@C.query("SELECT bool_or(lang <> 'fr') AS foreign_text, count(*) FILTER (lang = 'fr') AS french FROM documents")
def foreign_guard(spark, d):
    """Whether any contribution is not French."""
    return read(spark, d, "documents").agg(F.bool_or(F.col("lang") != "fr").alias("foreign_text"), F.count_if(F.col("lang") == "fr").alias("french"))


@C.query("SELECT size, lang, doc_id FROM (SELECT n_chars AS size, lang, doc_id FROM documents) ORDER BY size DESC, doc_id LIMIT 20")
def longest_contributions(spark, d):
    """The longest contributions, ties by id."""
    return read(spark, d, "documents").select(F.col("n_chars").alias("size"), "lang", "doc_id").orderBy(F.desc("size"), "doc_id").limit(20)


QUERIES, ORACLES = C.queries, C.oracles
