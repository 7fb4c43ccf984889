"""Naming, keywords, development and citations; sources stand for themes, languages for macro themes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import reasoning_bonus, tokens
from ..operators import naming
from ..operators.ordering import numbered_within
from ..sources.shared import checkpointed
from .base import Catalogue, read

C = Catalogue()
_TOK = "list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda t: length(t) >= 3)"
_DF = f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term"
_CTFIDF = f"""WITH c AS (SELECT source, term, count(*) AS tf FROM (SELECT source, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2), f AS (SELECT term, sum(tf) AS f FROM c GROUP BY 1), a AS (SELECT avg(n) AS a FROM (SELECT sum(tf) AS n FROM c GROUP BY source)),
    w AS (SELECT source, term, tf, tf * ln(1 + a / f) AS weight FROM c JOIN f USING (term), a)"""


@C.query(_DF)
def doc_frequency(spark, d):
    """Documents that hold each token."""
    return naming.frequencies(read(spark, d, "documents"), "text")


@C.query(f"SELECT term, df, round(ln(1 + (SELECT count(*) FROM documents) * 1.0 / df), 6) AS idf FROM ({_DF})")
def corpus_idf(spark, d):
    """Inverse document frequencies."""
    docs = read(spark, d, "documents")
    return naming.idf(naming.frequencies(docs, "text"), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@C.query(f"""WITH f AS ({_DF}), h AS (SELECT term, df FROM f WHERE df > (SELECT avg(df) + 3 * stddev_pop(df) FROM f)), l AS (SELECT df, lead(df) OVER (ORDER BY df DESC) AS below FROM (SELECT DISTINCT df FROM h)),
    c AS (SELECT arg_max(df, (df * 1.0 / below, df)) AS cut FROM l WHERE df * 1.0 / below >= 1.3) SELECT term, df FROM h, c WHERE cut IS NULL OR df >= cut""")
def corpus_stopwords(spark, d):
    """Terms so frequent that they name nothing."""
    return naming.stop_words(naming.frequencies(read(spark, d, "documents"), "text"))


@C.query(f"SELECT term, df FROM ({_DF}) WHERE length(term) <= 4 AND df > (SELECT avg(df) + stddev_pop(df) FROM ({_DF}))")
def functional_words(spark, d):
    """Short and frequent words, where no gap shows."""
    df = naming.frequencies(read(spark, d, "documents"), "text")
    bound = df.agg((F.avg("df") + F.stddev_pop("df")).alias("bound"))
    return df.where(F.length("term") <= 4).join(F.broadcast(bound), F.col("df") > F.col("bound")).select("term", "df")


@C.query(_CTFIDF + " SELECT source, term, tf, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(weight, 6) DESC, term) AS rank FROM w) WHERE rank <= 15")
def ctfidf_terms(spark, d):
    """The heaviest terms of each theme."""
    top = naming.top_terms(naming.class_terms(read(spark, d, "documents"), "source", "text"), "source", 15)
    return top.select("source", "term", "tf", F.round("weight", 6).alias("weight"), "rank")


@C.query()
def theme_keywords(spark, d):
    """Greedy keyword picks of each theme from 1- and 2-grams (sequential, so without SQL)."""
    docs = read(spark, d, "documents")
    terms = naming.with_bigrams(docs, "source", "text").groupBy("source", "term").agg(F.count("*").alias("weight"))
    return naming.pick_keywords(naming.top_terms(terms, "source", 60), "source", 8)


_TOP = _CTFIDF + ", k AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY round(weight, 6) DESC, term) AS rank FROM w QUALIFY rank <= 15)"


def _top(spark, d):
    return naming.top_terms(naming.class_terms(read(spark, d, "documents"), "source", "text"), "source", 15).select("source", "term", "rank")


@C.query(_TOP + " SELECT term, count(DISTINCT source) AS themes FROM k GROUP BY term HAVING count(DISTINCT source) > greatest(2, ceil(0.25 * (SELECT count(DISTINCT source) FROM k)))")
def generic_keywords(spark, d):
    """Keywords of too many themes."""
    top = _top(spark, d)
    bound = top.agg(F.greatest(F.lit(2), F.ceil(F.count_distinct("source") * 0.25)).alias("bound"))
    return top.groupBy("term").agg(F.count_distinct("source").alias("themes")).join(F.broadcast(bound), F.col("themes") > F.col("bound")).select("term", "themes")


@C.query(_TOP + ", n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT term, round(sum(n * 1.0 / rank), 6) AS score FROM k JOIN n USING (source) GROUP BY term ORDER BY score DESC, term LIMIT 40")
def dataset_keywords(spark, d):
    """Keywords of the whole, weighted by theme size and rank."""
    sizes = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return _top(spark, d).join(sizes, "source").groupBy("term").agg(F.round(F.sum(F.col("n") / F.col("rank")), 6).alias("score")).orderBy(F.desc("score"), "term").limit(40)


_DEV = f"""WITH r AS (SELECT doc_id, source, n_chars, least(1.0, ({" + ".join(f"CAST(contains(lower(text), '{m}') AS INTEGER)" for m in ('because', 'since', 'therefore', 'parce que', 'car ', 'donc', 'weil', 'denn', 'porque', 'por eso'))} + CAST(regexp_matches(text, '[0-9]') AS INTEGER)) / 2.0) AS bonus FROM documents),
    s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) * 1.0 / (count(*) OVER (PARTITION BY source) - 1) ELSE 0 END AS length_rank,
          greatest(0.05, quantile_cont(n_chars, 0.2) OVER (PARTITION BY source)) AS floor FROM r)
    SELECT doc_id, source, round((0.7 * length_rank + 0.3 * bonus) * least(1.0, n_chars / floor), 6) AS score FROM s"""


def _scores(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source", "n_chars", reasoning_bonus(F.col("text")).alias("bonus"))
    rows = numbered_within(rows, "source", ["n_chars", "doc_id"], "place", "n", checkpointed)
    length_rank = F.when(F.col("n") > 1, F.col("place") / (F.col("n") - 1)).otherwise(0.0)
    # neither places nor the quantile, an aggregate joined back, need a window that holds a theme
    floors = rows.groupBy("source").agg(F.greatest(F.lit(0.05), F.percentile("n_chars", 0.2)).alias("floor"))
    rows = rows.withColumn("length_rank", length_rank).join(floors, "source")
    gate = F.least(F.lit(1.0), F.col("n_chars") / F.col("floor"))
    return rows.select("doc_id", "source", F.round((0.7 * F.col("length_rank") + 0.3 * F.col("bonus")) * gate, 6).alias("score"))


@C.query(_DEV)
def development_score(spark, d):
    """How developed each contribution is within its theme."""
    return _scores(spark, d)


@C.query(f"SELECT doc_id, source, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM ({_DEV})) WHERE rank <= 10")
def citations_ranked(spark, d):
    """The citations of each theme, the most developed first."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "doc_id"))
    return _scores(spark, d).withColumn("rank", rank).where(F.col("rank") <= 10)


@C.query("""WITH f AS (SELECT doc_id, source, lower(text) AS t, n_chars, row_number() OVER (PARTITION BY source, lower(text) ORDER BY doc_id) AS c FROM documents)
    SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM f WHERE c = 1) WHERE rank <= 4""")
def representatives(spark, d):
    """Four representatives of each theme without literal repeats."""
    docs = read(spark, d, "documents").groupBy("source", F.lower("text").alias("t")).agg(F.min_by("n_chars", "doc_id").alias("n_chars"), F.min("doc_id").alias("doc_id"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return docs.select("source", "doc_id", rank.alias("rank")).where(F.col("rank") <= 4)


@C.query(_CTFIDF + f""", t AS (SELECT DISTINCT doc_id, source, unnest({_TOK}) AS term FROM documents), m AS (SELECT doc_id, source, round(avg(weight), 6) AS mean FROM t JOIN w USING (source, term) GROUP BY 1, 2)
    SELECT source, doc_id, mean, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mean DESC, doc_id) AS rank FROM m) WHERE rank <= 5""")
def distinctive_claims(spark, d):
    """The contributions whose terms weigh most in their theme."""
    docs = read(spark, d, "documents")
    weights = naming.class_terms(docs, "source", "text").select("source", "term", "weight")
    terms = docs.select("doc_id", "source", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    means = terms.join(weights, ["source", "term"]).groupBy("doc_id", "source").agg(F.round(F.avg("weight"), 6).alias("mean"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("mean"), "doc_id"))
    return means.withColumn("rank", rank).where(F.col("rank") <= 5).select("source", "doc_id", "mean", "rank")


@C.query("SELECT lang, round(avg(CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}])(the|der|les|los)([^\\p{L}]|$)') THEN 1.0 ELSE 0.0 END), 6) AS share FROM documents GROUP BY lang")
def term_saturation(spark, d):
    """Share of contributions that hold a pattern, by language."""
    hit = F.lower("text").rlike("(^|[^\\p{L}])(the|der|les|los)([^\\p{L}]|$)")
    return read(spark, d, "documents").groupBy("lang").agg(F.round(F.avg(hit.cast("double")), 6).alias("share"))


@C.query("""WITH t AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents), k AS (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY r) AS shown FROM t WHERE r <= 2 GROUP BY 1)
    SELECT source, count(*) AS n, max(shown) AS shown FROM documents JOIN k USING (source) GROUP BY source""")
def theme_blocks(spark, d):
    """Context of a theme for a report: its size and two representatives."""
    docs = read(spark, d, "documents").select("source", "doc_id", "n_chars")
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    shown = docs.withColumn("r", rank).where("r <= 2").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"].cast("string")), " ").alias("shown"))
    return docs.groupBy("source").agg(F.count("*").alias("n")).join(shown, "source")


_STOP = f"""f AS ({_DF}), h AS (SELECT term, df FROM f WHERE df > (SELECT avg(df) + 3 * stddev_pop(df) FROM f)), l AS (SELECT df, lead(df) OVER (ORDER BY df DESC) AS below FROM (SELECT DISTINCT df FROM h)),
    c AS (SELECT arg_max(df, (df * 1.0 / below, df)) AS cut FROM l WHERE df * 1.0 / below >= 1.3), stop AS (SELECT term FROM h, c WHERE cut IS NULL OR df >= cut)"""
_GRAMS = f"""t AS (SELECT source, {_TOK} AS ts FROM documents), g AS (SELECT source, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS term FROM t),
    n AS (SELECT source, term, count(*) AS n FROM g GROUP BY ALL), z AS (SELECT source, sum(n) AS size FROM n GROUP BY 1), k AS (SELECT term, sum(n) AS f FROM n GROUP BY 1),
    w AS (SELECT source, term, n / size AS tf, n / size * ln(1 + (SELECT avg(size) FROM z) / f) AS weight FROM n JOIN z USING (source) JOIN k USING (term))"""


@C.query(f"WITH {_GRAMS} SELECT source, term, round(tf, 9) AS tf, round(weight, 9) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(weight, 9) DESC, term) AS rank FROM w) WHERE rank <= 15")
def ctfidf_grams(spark, d):
    """The heaviest 1- and 2-grams of each theme."""
    docs = read(spark, d, "documents")
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("weight"), "term"))
    grams = naming.heavy_grams(docs, checkpointed(naming.token_counts(docs, "source", "text")), "source", "text", 15, checkpointed)
    top = grams.withColumn("rank", rank).where("rank <= 15")
    return top.select("source", "term", F.round("tf", 9).alias("tf"), "weight", "rank")


@C.query(f"""WITH {_STOP}, {_GRAMS}, o AS (SELECT source, list(term ORDER BY round(weight, 9) DESC, term) AS ts FROM w WHERE len(list_filter(string_split(term, ' '), lambda x: x IN (SELECT term FROM stop))) = 0 GROUP BY 1),
    p AS (SELECT source, list_reduce(list_concat([[]::VARCHAR[]], list_transform(ts[1:2000], lambda x: [x])), lambda a, x: CASE WHEN len(a) < 8 AND len(list_filter(a, lambda y: list_contains(string_split(y, ' '), x[1]) OR list_contains(string_split(x[1], ' '), y))) = 0 THEN list_concat(a, x) ELSE a END) AS ks FROM o)
    SELECT source, unnest(range(1, len(ks) + 1))::INTEGER AS pick, unnest(ks) AS term FROM p""".replace("len(list_filter(string_split(term, ' '), lambda x: x IN (SELECT term FROM stop))) = 0", "NOT list_has_any(string_split(term, ' '), (SELECT list(term) FROM stop))"))
def keyword_picks(spark, d):
    """Keywords of each theme: the heaviest grams without stop words and without repeats of their words."""
    docs = read(spark, d, "documents")
    counts = checkpointed(naming.token_counts(docs, "source", "text"))
    df = counts.where(F.col("term") != "").groupBy("term").agg(F.sum("docs").alias("df"))
    stop = checkpointed(naming.stop_words(checkpointed(df)).select("term"))
    # a pick keeps two words out at most, so the grams down to the 15th word hold all eight picks
    return naming.keywords(checkpointed(naming.heavy_grams(docs, counts, "source", "text", 15, checkpointed, stop)), stop, "source", 8, checkpointed)


QUERIES, ORACLES = C.queries, C.oracles
