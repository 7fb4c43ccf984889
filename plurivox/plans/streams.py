"""Windows over `events` in batch form (the same functions run on streams), and nested JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import raw
from ..streaming import events, state
from .base import Catalogue, read

C = Catalogue()


@C.query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    """Hourly counts by type."""
    return events.tumbling(read(spark, d, "events"), "ts", ["event_type"], "1 hour")


@C.query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1, 2""")
def sliding_rate(spark, d):
    """Counts over an hour every half hour."""
    return events.sliding(read(spark, d, "events"), "ts", ["event_type"], "1 hour", "30 minutes")


@C.query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    """Sessions with a gap of six hours."""
    return events.sessions(read(spark, d, "events"), "ts", ["user_id"], "6 hours")


@C.query("""SELECT event_id, user_id, n AS in_window FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3600 seconds' PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 1""")
def rate_limited(spark, d):
    """Events beyond a user's rate."""
    return events.over_rate(read(spark, d, "events").select("event_id", "user_id", "ts"), "ts", "user_id", 3600, 1).select("event_id", "user_id", "in_window")


@C.query("SELECT DISTINCT user_id, event_type FROM events")
def first_seen(spark, d):
    """Each user and type once."""
    return events.first_seen(read(spark, d, "events"), "ts", ["user_id", "event_type"]).select("user_id", "event_type")


@C.query("WITH m AS (SELECT max(ts) AS top FROM events) SELECT event_type, sum(CASE WHEN ts < top - INTERVAL '7 days' THEN 1 ELSE 0 END) AS late, count(*) AS n FROM events, m GROUP BY 1")
def late_rows(spark, d):
    """Rows a watermark of a week would drop at the end."""
    rows = read(spark, d, "events")
    top = rows.agg(F.max("ts").alias("top"))
    return rows.crossJoin(F.broadcast(top)).groupBy("event_type").agg(F.count_if(F.col("ts") < F.col("top") - F.expr("interval 7 days")).alias("late"), F.count("*").alias("n"))


@C.query("""SELECT CAST(conv_id AS VARCHAR) AS conv_id, NULL AS "turns.note", CAST(turn AS VARCHAR) AS "turns.turn", role AS "turns.role" FROM conversations UNION ALL SELECT CAST(conv_id AS VARCHAR), 'note ' || role, NULL, NULL FROM (SELECT DISTINCT conv_id, role FROM conversations)""".replace('"turns.note"', '"notes"'))
def flatten_json(spark, d):
    """Nested records with two sibling lists as rows."""
    rows = read(spark, d, "conversations")
    nested = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"), F.transform(F.collect_set("role"), lambda r: F.concat(F.lit("note "), r)).alias("notes"))
    return raw.flatten(nested)


@C.query("""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT b.vec_id, count(*) AS before, count(*) FILTER (list_dot_product(v, e.embedding::DOUBLE[]) >= 0.3) AS close, round(max(list_dot_product(v, e.embedding::DOUBLE[])), 6) AS top
        FROM b LEFT JOIN embeddings e ON e.vec_id % 20 <> 0 OR e.vec_id < b.vec_id GROUP BY b.vec_id) SELECT make_timestamp(2024, 1, 1, 0, 0, 0.0) + to_seconds(vec_id) AS ts, before, close, top FROM c""")
def submissions_batch(spark, d):
    """A batch of submissions (every twentieth vector) against the store of all others and those before them in the batch."""
    rows = read(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("text"), F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id")).alias("ts"), F.col("embedding").alias("vec"))
    return events.correlate(rows.where("vec_id % 20 = 0").drop("vec_id"), rows.where("vec_id % 20 != 0").drop("vec_id"), 0.3)


@C.query("""WITH u AS (SELECT user_id AS dataset, event_id AS seq, event_type, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'view' THEN 'building' ELSE 'error' END AS status FROM events),
    s AS (SELECT dataset, arg_max(status, seq) AS status FROM u GROUP BY 1), f AS (SELECT dataset, string_agg(event_type || '=' || m, ',' ORDER BY event_type) AS fields FROM (SELECT dataset, event_type, max(seq) AS m FROM u GROUP BY 1, 2) GROUP BY 1)
    SELECT dataset, CASE WHEN status = 'ready' AND dataset % 2 = 1 THEN 'absent' ELSE status END AS status, fields FROM s JOIN f USING (dataset)""")
def status_states(spark, d):
    """Builds (users) with the status of their last update and the latest value of each field; ready ones without an artefact count as absent."""
    rows = read(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", state.READY).when(F.col("event_type") == "view", state.BUILDING).otherwise(state.ERROR)
    updates = rows.select(F.col("user_id").alias("dataset"), F.col("event_id").alias("seq"), status.alias("status"), F.create_map("event_type", F.col("event_id").cast("string")).alias("fields"))
    names = updates.select("dataset").distinct()
    found = state.effective(state.fold_updates(updates), names.where("dataset % 2 = 0"), names)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("dataset", "status", text.alias("fields"))


@C.query("""WITH n AS (SELECT source, lang AS name, sum(n_chars) AS size FROM documents WHERE source <> 'src1' GROUP BY 1, 2), k AS (SELECT source, lang AS name, sum(n_chars) AS size FROM documents WHERE source <> 'src3' AND (doc_id % 11 <> 0 OR length(source) = 4) GROUP BY 1, 2),
    a AS (SELECT source, string_agg(name || ':' || size, ',' ORDER BY name) AS s FROM n GROUP BY 1), b AS (SELECT source, string_agg(name || ':' || size, ',' ORDER BY name) AS s FROM k GROUP BY 1)
    SELECT source, CASE WHEN b.s IS NULL THEN 'new' WHEN a.s IS NULL THEN 'gone' WHEN a.s = b.s THEN 'valid' ELSE 'changed' END AS state FROM a FULL JOIN b USING (source)""")
def signature_states(spark, d):
    """Which kept results (by source) still fit what they were made from."""
    docs = read(spark, d, "documents").select("source", F.col("lang").alias("name"), "n_chars", "doc_id")
    parts = lambda rows: state.signatures(rows.groupBy("source", "name").agg(F.sum("n_chars").alias("size")), "source")
    return state.staleness(parts(docs.where("source != 'src3' and (doc_id % 11 != 0 or length(source) = 4)")), parts(docs.where("source != 'src1'")), "source")


QUERIES, ORACLES = C.queries, C.oracles
