"""Segmentation. Texts are `documents` cut into lines and `conversations` cut into the lines of their turns; a line's vector counts eight letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, segment
from .base import Catalogue, read

C = Catalogue()
LETTERS = "aeinorst"
WIDTH, DEPTH = 4, 0.8


def _vector(line):
    return F.array(*((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("double") for c in LETTERS))


def _lines(text):
    return F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), _vector)


def _texts(spark, d):
    return read(spark, d, "documents").select("doc_id", _lines(F.col("text")).alias("units"))


def _turns(spark, d):
    """conv_id, units, truth: the lines of a conversation, and where turns begin."""
    rows = read(spark, d, "conversations").select("conv_id", F.struct("turn", _lines(F.col("text")).alias("units")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    starts = F.transform(F.sequence(F.lit(1), F.size("ts")), lambda k: F.aggregate(F.slice("ts", 1, k - 1), F.lit(0), lambda s, t: s + F.size(t["units"])))
    total = F.aggregate("ts", F.lit(0), lambda s, t: s + F.size(t["units"]))
    return turns.select("conv_id", F.flatten(F.transform("ts", lambda t: t["units"])).alias("units"), F.array_distinct(F.filter(starts, lambda p: (p > 0) & (p < total))).alias("truth"))


_UNITS = f"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), u AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM l),
    x AS (SELECT doc_id, n, i, unnest({list(LETTERS)}) AS c, (length(l) - length(replace(l, unnest({list(LETTERS)}), '')))::DOUBLE AS v FROM u)"""
_BLOCKS = f"""{_UNITS}, w AS (SELECT doc_id, n, i, c, avg(v) OVER (PARTITION BY doc_id, c ORDER BY i ROWS BETWEEN {WIDTH} PRECEDING AND 1 PRECEDING) AS a, avg(v) OVER (PARTITION BY doc_id, c ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS b FROM x),
    s AS (SELECT doc_id, n, i, round(CASE WHEN sum(a * a) > 0 AND sum(b * b) > 0 THEN sum(a * b) / sqrt(sum(a * a)) / sqrt(sum(b * b)) ELSE 1 END, 9) AS s FROM w WHERE i > 0 GROUP BY ALL)"""


@C.query(f"{_BLOCKS} SELECT doc_id, CAST(i AS INTEGER) AS boundary, round(s, 6) AS similarity FROM s")
def block_cosine(spark, d):
    """Likeness of the lines before and after each boundary."""
    rows = segment.similarities(_texts(spark, d), "doc_id", "units", WIDTH)
    return rows.select("doc_id", F.posexplode("similarity").alias("k", "s")).select("doc_id", (F.col("k") + 1).alias("boundary"), F.round("s", 6).alias("similarity"))


@C.query(f"""{_UNITS}, m AS (SELECT doc_id, n, i, c, CASE WHEN n > 2 THEN avg(v) OVER (PARTITION BY doc_id, c ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE v END AS v FROM x), z AS (SELECT doc_id, i, sqrt(sum(v * v)) AS z FROM m GROUP BY ALL),
    q AS (SELECT doc_id, i, c, CASE WHEN z > 0 THEN v / z ELSE v END AS v FROM m JOIN z USING (doc_id, i)), p AS (SELECT *, avg(v) OVER (PARTITION BY doc_id, c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM q)
    SELECT doc_id, CAST(i AS INTEGER) AS line, round(round(CASE WHEN sum(g * g) > 0 THEN sum(v * g) / sqrt(sum(g * g)) ELSE 1 END, 9), 6) AS novelty FROM p WHERE i > 0 GROUP BY ALL""")
def running_novelty(spark, d):
    """Likeness of each line to the centroid of all lines before it."""
    rows = segment.novelties(_texts(spark, d), "doc_id", "units", WIDTH)
    return rows.select("doc_id", F.posexplode("novelty").alias("k", "s")).select("doc_id", (F.col("k") + 1).alias("line"), F.round("s", 6).alias("novelty"))


@C.query(f"""{_BLOCKS}, g AS (SELECT avg(s) AS mu, coalesce(nullif(stddev_pop(s), 0), 1e-6) AS sd FROM s), e AS (SELECT *, lag(s) OVER o AS before, lead(s) OVER o AS after FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT doc_id, n, list(CAST(i AS INTEGER) ORDER BY round(mu - s, 9) DESC, i) AS cs FROM e, g WHERE n >= 6 AND s <= coalesce(before, 9) AND s <= coalesce(after, 9) AND s < round(mu - {DEPTH} * sd, 9) AND i BETWEEN 3 AND n - 3 GROUP BY ALL),
    t AS (SELECT doc_id, list_sort(list_reduce(list_concat([[]::INTEGER[]], list_transform(cs, lambda x: [x])), lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y - x[1]) < 3)) = 0 THEN list_concat(a, x) ELSE a END)) AS bs FROM c)
    SELECT doc_id, coalesce(array_to_string(bs, ','), '') AS boundaries FROM documents LEFT JOIN t USING (doc_id)""")
def text_tiling(spark, d):
    """Boundaries at spaced minima of the likeness of neighbouring blocks, calibrated over all texts."""
    return segment.by_tiling(_texts(spark, d), "doc_id", "units", WIDTH, DEPTH).select("doc_id", F.array_join(F.col("boundaries").cast("array<string>"), ",").alias("boundaries"))


@C.query()
def centroid_segments(spark, d):
    """Boundaries where a line leaves the centroid of its segment so far (sequential, so without SQL)."""
    return segment.by_centroid(_texts(spark, d), "doc_id", "units", WIDTH, 1.0)


@C.query()
def change_points(spark, d):
    """Boundaries of the segmentation of least distance (dynamic programming, so without SQL)."""
    return segment.by_change(_texts(spark, d), "doc_id", "units", WIDTH, 0.05)


@C.query()
def community_segments(spark, d):
    """Boundaries between communities of each text's line graph (iterative, so without SQL)."""
    return segment.by_communities(_texts(spark, d), "doc_id", "units", 4, 0.3, 0.5)


@C.query()
def boundary_scorecard(spark, d):
    """Change points of conversations against the beginnings of their turns, within one line; mean Pk and WindowDiff at a lag of two lines."""
    turns = _turns(spark, d)
    found = segment.by_change(turns, "conv_id", "units", 1, 0.05).join(turns.select("conv_id", "truth", F.size("units").alias("n")), "conv_id")
    each = found.select("conv_id", "truth", "boundaries", F.explode(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1)).alias("pos"))
    marks = each.select("conv_id", "pos", F.array_contains("truth", F.col("pos")).cast("int").alias("ref"), F.array_contains("boundaries", F.col("pos")).cast("int").alias("hyp"))
    errors = evaluate.pk_window_diff(marks, "conv_id", "pos", 2).agg(F.round(F.avg("pk"), 6).alias("pk"), F.round(F.avg("window_diff"), 6).alias("window_diff"))
    return segment.scorecard(found, "truth", "boundaries").crossJoin(F.broadcast(errors))  # two single rows


QUERIES, ORACLES = C.queries, C.oracles
