"""Ideas, claims and their spans. Contributions are `documents`; a contribution's lines stand for what a model would extract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lang
from ..operators import claims, ingest
from ..sources.shared import checkpointed
from .base import Catalogue, read
from .texts import _CLEAN, _MASKED, SALT

C = Catalogue()
_LINES = "SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents"
#: The lines of every document with their numbers from 0, as `l` and `i`.
_NUMBERED = f"SELECT doc_id, text, unnest(lines) AS l, unnest(range(len(lines))) AS i FROM ({_LINES})"


def _start(nth: str) -> str:
    """SQL: where the occurrence `nth` of `l` begins in `text`."""
    n = f"CAST(({nth}) % (len(string_split(text, l)) - 1) AS BIGINT)"
    return f"CAST(list_sum(list_transform(list_slice(string_split(text, l), 1, {n} + 1), lambda x: length(x))) + {n} * length(l) AS BIGINT)"


#: Each line where it stands: the n-th of equal lines at the n-th of their occurrences, starting over when these are used up.
_PLACED = f"""SELECT *, {_start("nth")} AS s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) - 1 AS nth FROM ({_NUMBERED}))"""
_FIRST_WORD = "regexp_extract(l, '^[^ ]+')"


def _lines(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return read(spark, d, "documents").select("doc_id", "text", lines.alias("lines"))


def _aligned(spark, d):
    """Each line as a claim of three parts: itself, itself with other white space, and words that stand nowhere."""
    docs = _lines(spark, d)
    part = lambda x: F.array(x, F.replace(x, F.lit(" "), F.lit(" \t ")), F.concat(x, F.lit(" ✗")))
    asked = docs.select("doc_id", F.posexplode("lines").alias("claim", "l")).select("doc_id", "claim", part(F.col("l")).alias("parts"), F.regexp_extract("l", "^[^ ]+", 0).alias("target"))
    return claims.align(docs.select("doc_id", "text"), asked, "doc_id")


@C.query(f"""WITH p AS ({_PLACED}), flat AS (SELECT *, translate(text, chr(10), ' ') AS t FROM p), q AS (SELECT *, s + length(l) AS e, instr(t, l) - 1 AS s2, instr(text, {_FIRST_WORD}) - 1 AS ts FROM flat),
    once AS (SELECT doc_id, l, count(*) AS n FROM q GROUP BY ALL)
    SELECT doc_id, CAST(i AS INTEGER) AS claim, CASE WHEN instr(l, ' ') > 0 THEN s || '-' || e || ',' || s2 || '-' || (s2 + length(l)) ELSE two END AS spans, md5(l || ' ' || l) AS text_md5, CAST(ts AS INTEGER) AS target_start, CAST(ts + length({_FIRST_WORD}) AS INTEGER) AS target_end
    FROM (SELECT q.*, one || ',' || other AS two FROM (SELECT *, s4 || '-' || (s4 + length(l)) AS one, s5 || '-' || (s5 + length(l)) AS other FROM (SELECT *,
        {_start("2 * nth")} AS s4, {_start("2 * nth + 1")} AS s5 FROM q)) q)""")
def claim_alignment(spark, d):
    """Every line of every contribution anchored, as it stands and with other white space; what stands nowhere is left out."""
    rows = _aligned(spark, d)
    text_of = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return rows.select("doc_id", "claim", text_of.alias("spans"), F.md5(F.regexp_replace("text", "\n", " ")).alias("text_md5"), F.col("target.start").alias("target_start"), F.col("target.end").alias("target_end"))


def _stored(spark, d):
    """Contributions with their lines as stored claims, in the three forms by turns; every fifth contribution has none, so that the whole text stands in."""
    docs = _lines(spark, d)
    size = lambda x: F.length(x)
    new = lambda x, at: F.to_json(F.struct(x.alias("text"), F.array(F.array(at, at + size(x)), F.array(at)).alias("spans"), F.array(at, at + 1).alias("target")))
    old = lambda x, at: F.to_json(F.struct(x.alias("text"), at.alias("start"), (at + size(x)).alias("end")))
    at = lambda x: F.position(x, F.col("text")) - 1
    form = lambda x, i: F.when(i % 3 == 0, new(x, at(x))).when(i % 3 == 1, old(x, at(x))).otherwise(F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    raw = F.when(F.col("doc_id") % 5 == 0, F.array(F.to_json(claims.whole(F.col("text"))))).otherwise(F.transform("lines", form))
    return docs.select(F.col("doc_id").alias("avis_id"), "doc_id", (F.col("doc_id") % 3 + 1.0).alias("weight"), "text", raw.alias("claims"))


@C.query(f"""WITH l AS (SELECT doc_id, text, l, i FROM ({_NUMBERED}) WHERE doc_id % 5 <> 0), w AS (SELECT doc_id, i AS pos, l, instr(text, l) - 1 AS s, CASE WHEN i % 3 = 0 THEN instr(text, l) - 1 END AS ts FROM l
        UNION ALL SELECT doc_id, 0, text, -1, NULL FROM documents WHERE doc_id % 5 = 0)
    SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS claim_index, doc_id AS avis_id, CAST(pos AS INTEGER) AS pos, doc_id % 3 + 1.0 AS weight, md5(l) AS text_md5,
        CAST(s AS INTEGER) AS start, CAST(CASE WHEN s < 0 THEN -1 ELSE s + length(l) END AS INTEGER) AS end, CAST(ts AS INTEGER) AS target_start FROM w""")
def claims_flatten(spark, d):
    """All stored claims in one table, numbered through in the order of their contributions."""
    rows = claims.flatten(_stored(spark, d), "doc_id", checkpointed)
    first = F.col("spans")[0]
    return rows.select("claim_index", "avis_id", "pos", "weight", F.md5("text").alias("text_md5"), first["start"].alias("start"), first["end"].alias("end"), F.col("target.start").alias("target_start"))


_HITS = {code: f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in ws.split())})))" for code, ws in lang.FUNCTION_WORDS.items()}
_BEST = f"greatest({', '.join(f'n_{k}' for k in _HITS)})"
_HEAD = "regexp_replace(CASE WHEN instr(substr(clean, 1, 60), ' ') > 0 THEN regexp_replace(substr(clean, 1, 60), ' [^ ]*$', '') ELSE substr(clean, 1, 60) END, '[,;:.\\- ]+$', '')"


@C.query(f"""WITH c AS (SELECT doc_id, source, lang, n_chars, text, {_CLEAN} AS clean, {_MASKED.format(x="trim(text)")} AS masked FROM documents), k AS (SELECT *, regexp_extract_all(lower(clean), '\\p{{L}}+') AS ws FROM c WHERE length(clean) >= 30 AND length(regexp_replace(clean, '[^\\p{{L}}]', '', 'g')) >= 2),
    n AS (SELECT *, {", ".join(f"{v} AS n_{k}" for k, v in _HITS.items())} FROM k)
    SELECT source || ':' || doc_id AS id, CASE WHEN length(clean) <= 60 THEN clean ELSE rtrim(CASE WHEN {_HEAD} = '' THEN substr(clean, 1, 60) ELSE {_HEAD} END) || '…' END AS label, md5(masked) AS text_md5, md5(clean) AS clean_md5, 'then' AS ts,
        CASE WHEN doc_id % 3 = 0 THEN CASE WHEN {_BEST} = 0 THEN 'und' {" ".join(f"WHEN n_{k} = {_BEST} THEN '{k}'" for k in _HITS)} END ELSE lang END AS lang,
        substr(sha256('{SALT}|' || source || '|' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(n_chars AS VARCHAR) END), 1, 16) AS author_hash, source, CASE WHEN doc_id % 2 = 0 THEN 2.5 ELSE 1.0 END AS weight, 'kept' AS prop, 1 AS n_props FROM n""")
def ideas_build(spark, d):
    """Contributions to ideas: cleaned, filtered, labelled, masked, hashed, with language and weight."""
    id_ = F.col("doc_id")
    raw = read(spark, d, "documents").select(
        "source", id_.alias("raw_id"), "text", F.when(id_ % 3 == 0, " ").otherwise(F.col("lang")).alias("lang"), F.when(id_ % 4 != 0, F.col("n_chars").cast("string")).alias("author"), F.lit(" then ").alias("ts"),
        F.when(id_ % 2 == 0, "2.5").otherwise("many").alias("weight"), F.create_map(F.lit("topic"), F.lit("kept"), F.lit("source"), F.lit("never")).alias("props"),
    )
    rows = ingest.ideas(raw, SALT, 60, 30)
    return rows.select("id", "label", F.md5("text").alias("text_md5"), F.md5("text_clean").alias("clean_md5"), "ts", "lang", "author_hash", "source", "weight", F.col("props")["topic"].alias("prop"), F.size("props").alias("n_props"))


QUERIES, ORACLES = C.queries, C.oracles
