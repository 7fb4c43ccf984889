"""Ingestion: profiles, unpivoting, dedup, caps, samples, portal pages and ledgers.

`customer`, `orders` and `part` stand for survey exports, `documents` for contributions, `pages` for portal pages and
`events` for flags and calls.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ingest, profile
from .base import Catalogue, read

C = Catalogue()
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT {i} AS question_index, '{c}' AS question, nullif(trim({cast}), '') AS a FROM {table}" for i, (c, cast) in enumerate(columns.items()))
    return f"""WITH l AS ({parts}),
        s AS (SELECT question_index, question, count(a) AS n_answers, least(count(DISTINCT a), {profile.DISTINCT_CAP}) AS n_distinct, coalesce(count(DISTINCT a) * 1.0 / nullif(count(a), 0), 0) AS r,
              coalesce(sum(length(a)) * 1.0 / nullif(count(a), 0), 0) AS m, coalesce(max(length(a)), 0) AS max_len, coalesce(avg(CAST(regexp_matches(a, '{profile.DATE}') AS DOUBLE)), 0) AS d,
              coalesce(avg(CAST(regexp_matches(a, '{profile.NUMERIC}') AS DOUBLE)), 0) AS x FROM l GROUP BY 1, 2)
        SELECT question_index, question, n_answers, n_distinct, round(r, 6) AS distinct_ratio, round(m, 4) AS avg_len, max_len,
               CASE WHEN n_answers = 0 THEN 'empty' WHEN d >= 0.9 THEN 'date' WHEN x >= 0.95 THEN 'numeric'
                    WHEN n_answers >= 10 AND ((m >= 60 AND r >= 0.05) OR (m >= 25 AND r >= 0.5) OR (m >= 25 AND max_len >= 500 AND n_distinct >= 100)) THEN 'open_text' ELSE 'closed' END AS kind FROM s"""


@C.query(_profile_sql("documents", {"text": "text", "lang": "lang", "source": "source", "n_chars": "CAST(n_chars AS VARCHAR)"}))
def column_profile(spark, d):
    """Statistics and kinds of the columns of contributions."""
    return profile.profile(read(spark, d, "documents"), ["text", "lang", "source", "n_chars"])


@C.query("SELECT question, kind FROM (" + _profile_sql("part", {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "CAST(p_size AS VARCHAR)"}) + ")")
def column_kind(spark, d):
    """Kinds of the columns of another export."""
    return profile.profile(read(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size"]).select("question", "kind")


@C.query("""SELECT c_custkey, question_index, question, answer FROM (
    SELECT c_custkey, 0 AS question_index, 'c_name' AS question, nullif(trim(c_name), '') AS answer FROM customer
    UNION ALL SELECT c_custkey, 1, 'c_mktsegment', nullif(trim(c_mktsegment), '') FROM customer) WHERE answer IS NOT NULL""")
def melt_open_text(spark, d):
    """Kept columns as rows of answers."""
    return profile.melt(read(spark, d, "customer"), ["c_name", "c_mktsegment"], ["c_custkey"])


@C.query("SELECT o_orderkey, o_orderpriority AS question, c_mktsegment AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def contributions_view(spark, d):
    """Answers joined with their questions, of one kind of question."""
    questions = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(questions, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderpriority").alias("question"), F.col("c_mktsegment").alias("answer"))


@C.query("SELECT min(doc_id) AS doc_id, 1.0 + count(*) - 1 AS weight FROM documents GROUP BY text")
def exact_dedup_weight(spark, d):
    """Distinct contributions with the weight of their repeats."""
    return ingest.exact_dedup(read(spark, d, "documents"), "text", "doc_id", F.lit(1.0)).select("doc_id", "weight")


@C.query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def source_cap(spark, d):
    """A cap of rows for each source (the operator under test)."""
    return ingest.cap(read(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 20)


@C.query("SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS turn FROM documents) ORDER BY turn, lang LIMIT 120")
def balanced_sample(spark, d):
    """A sample balanced over languages (the operator under test)."""
    return ingest.balanced(read(spark, d, "documents").select("doc_id", "lang"), ["lang"], F.md5(F.col("doc_id").cast("string").cast("binary")), 120)


@C.query("SELECT doc_id, lang, source FROM documents WHERE coalesce(lang, '') IN ('fr', 'es') AND coalesce(source, '') IN ('src1', 'src2', 'src3')")
def keep_where(spark, d):
    """Rows with allowed values."""
    return ingest.keep_where(read(spark, d, "documents"), {"lang": ["fr", "es"], "source": ["src1", "src2", "src3"]}).select("doc_id", "lang", "source")


@C.query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_distinct, sum(n_chars) AS chars FROM documents GROUP BY source, lang")
def ingest_counters(spark, d):
    """Counters by source and language."""
    by_text = read(spark, d, "documents").groupBy("source", "lang", F.xxhash64("text").alias("h"), "text").agg(F.count("*").alias("c"), F.sum("n_chars").alias("k"))
    return by_text.groupBy("source", "lang").agg(F.sum("c").alias("n"), F.count("text").alias("n_distinct"), F.sum("k").alias("chars"))


@C.query("SELECT lang, count(*) AS n, mode() WITHIN GROUP (ORDER BY source) IS NOT NULL AS has_source FROM documents GROUP BY lang")
def language_counts(spark, d):
    """Languages and whether a most common source exists."""
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.mode("source", True).isNotNull().alias("has_source"))


_LINK = 'href="([^"#]+)'


@C.query(f"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href FROM pages),
    a AS (SELECT page_id, site, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN href LIKE '/%' THEN site || href ELSE site || '/' || href END AS link FROM l)
    SELECT DISTINCT page_id, link, starts_with(link, site || '/') OR link = site AS same_host FROM a""")
def link_index(spark, d):
    """Absolute links of portal pages, each once, and whether they stay on the host."""
    site = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    links = read(spark, d, "pages").select("page_id", site.alias("site"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("href"))
    link = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("site", "href")).otherwise(F.concat("site", F.lit("/"), "href"))
    return links.select("page_id", "site", link.alias("link")).select("page_id", "link", (F.col("link").startswith(F.concat("site", F.lit("/"))) | (F.col("link") == F.col("site"))).alias("same_host")).distinct()


_STEM = r"regexp_replace(regexp_extract({u}, '^[^?#]*', 0), '(\.[a-z]+|/)$', '')"


@C.query(f"""WITH p AS (SELECT page_id, {_STEM.format(u='url')} AS stem, regexp_extract(url, '\\.html') = '.html' AS page FROM pages)
    SELECT page_id, NOT page AND stem IN (SELECT stem FROM p WHERE page) AS redundant FROM p""")
def twin_redundancy(spark, d):
    """Pages with a twin of the preferred format under the same stem."""
    stem = F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), r"(\.[a-z]+|/)$", "")
    pages = read(spark, d, "pages").select("page_id", stem.alias("stem"), F.col("url").contains(".html").alias("page"))
    twins = pages.where("page").select("stem", F.lit(True).alias("twin")).distinct()
    return pages.join(twins, "stem", "left").select("page_id", (~F.col("page") & F.coalesce("twin", F.lit(False))).alias("redundant"))


@C.query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page_no FROM pages")
def url_parts(spark, d):
    """Parts of portal URLs."""
    part = lambda p: F.regexp_extract("url", p, 1)
    return read(spark, d, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("://([^/?#]+)").alias("host"), part("://[^/?#]+([^?#]*)").alias("path"), part("[?&]page=([0-9]+)").alias("page_no"))


@C.query("SELECT CASE WHEN u LIKE '%.html' THEN 'html' WHEN u LIKE '%/' THEN 'index' ELSE 'other' END AS format, count(*) AS n FROM (SELECT regexp_extract(url, '^[^?#]*', 0) AS u FROM pages) GROUP BY 1")
def format_tags(spark, d):
    """Formats by suffix, the longest first."""
    bare = F.regexp_extract("url", "^[^?#]*", 0)
    return read(spark, d, "pages").groupBy(F.when(bare.endswith(".html"), "html").when(bare.endswith("/"), "index").otherwise("other").alias("format")).agg(F.count("*").alias("n"))


@C.query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def props_extract(spark, d):
    """Free properties of events as columns."""
    return read(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'empty' END"


@C.query(f"""WITH f AS (SELECT o_custkey, {_STATUS} AS status FROM orders), c AS (SELECT o_custkey, count(*) AS files, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'empty') AS empty,
    count(*) FILTER (status = 'skipped') AS skipped FROM f GROUP BY 1)
    SELECT *, CASE WHEN files = 0 THEN 'no_data_files' WHEN ok > 0 AND error = 0 THEN 'ok' WHEN ok > 0 THEN 'partial' WHEN error > 0 THEN 'error' WHEN skipped > 0 THEN 'skipped' ELSE 'empty' END AS state FROM c""")
def status_rollup(spark, d):
    """Status of each customer (consultation) from its orders (files)."""
    return ingest.status_rollup(read(spark, d, "orders").select("o_custkey", F.expr(_STATUS).alias("status")), "o_custkey")


@C.query("""SELECT user_id, event_type, min(ts) AS created, max(ts) AS updated, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def flags_latest(spark, d):
    """The latest flag of each target, with the time of the first."""
    rows = ingest.latest(read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id")
    return rows.select("user_id", "event_type", "created", F.col("row.ts").alias("updated"), F.col("row.value").alias("value"))


@C.query("""WITH l AS (SELECT l_returnflag AS phase, l_linestatus AS model, count(*) AS calls, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS tokens FROM lineitem GROUP BY 1, 2)
    SELECT phase, model, calls, CAST(tokens AS DOUBLE) AS tokens, round(CAST(tokens AS DOUBLE) / 1000 * CASE model WHEN 'F' THEN 0.25 ELSE 0.5 END, 6) AS price FROM l""")
def cost_ledger(spark, d):
    """Calls, tokens and price by phase and model (flags and line statuses stand for them)."""
    tokens = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    prices = spark.createDataFrame([("F", 0.25), ("O", 0.5)], "model string, per_thousand double")
    sums = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("phase"), F.col("l_linestatus").alias("model")).agg(F.count("*").alias("calls"), tokens.alias("tokens"))
    return sums.join(F.broadcast(prices), "model").select("phase", "model", "calls", "tokens", F.round(F.col("tokens") / 1000 * F.col("per_thousand"), 6).alias("price"))


@C.query("SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def without_value_anti(spark, d):
    """Respondents without a real value."""
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@C.query("WITH g AS (SELECT lang, source, count(*) AS n, count(DISTINCT doc_id % 3) AS k FROM documents GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT doc_id % 3) >= 2) SELECT doc_id, lang, source FROM documents SEMI JOIN g USING (lang, source)")
def question_groups(spark, d):
    """Rows of groups that are large and mixed enough."""
    docs = read(spark, d, "documents")
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.countDistinct(F.col("doc_id") % 3).alias("k")).where("n >= 5 and k >= 2")
    return docs.join(groups, ["lang", "source"], "left_semi").select("doc_id", "lang", "source")


@C.query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), q AS (SELECT min(n) AS quota FROM c), r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r FROM documents) SELECT doc_id, lang, source FROM r, q WHERE r <= quota")
def balanced_cells(spark, d):
    """As many rows of each language and source as the smallest cell has."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    quota = docs.groupBy("lang", "source").count().agg(F.min("count").alias("quota"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))))
    return docs.withColumn("r", rank).join(F.broadcast(quota), F.col("r") <= F.col("quota")).select("doc_id", "lang", "source")


@C.query("SELECT DISTINCT md5(text) AS key FROM conversations WHERE role = 'user' AND md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE role = 'assistant')")
def cache_misses(spark, d):
    """Contents, by their key, that a cache lacks (answers stand for the cache)."""
    rows = read(spark, d, "conversations").select("role", F.md5(F.col("text").cast("binary")).alias("key"))
    return rows.where("role = 'user'").select("key").distinct().join(rows.where("role = 'assistant'").select("key"), "key", "left_anti")


QUERIES, ORACLES = C.queries, C.oracles
