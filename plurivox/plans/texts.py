"""Text functions over `documents` (contributions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lang, text
from .base import Catalogue, read

C = Catalogue()
SALT = "plurivox-example-salt-of-32-characters"
_WORDS = "regexp_extract_all(lower(text), '\\p{L}+')"


def _lang_sql() -> str:
    n = {code: f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in ws.split())})))" for code, ws in lang.FUNCTION_WORDS.items()}
    cols = ", ".join(f"{v} AS n_{k}" for k, v in n.items())
    best = f"greatest({', '.join(f'n_{k}' for k in n)})"
    whens = " ".join(f"WHEN n_{k} = {best} THEN '{k}'" for k in n)
    return f"""WITH w AS (SELECT doc_id, lang, text, {_WORDS} AS ws FROM documents), n AS (SELECT doc_id, lang, text, {cols} FROM w)
        SELECT doc_id, lang, CASE WHEN length(trim(text)) < 3 THEN 'und' WHEN {best} = 0 THEN 'und' {whens} END AS guess FROM n"""


_MASKED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]*[\p{{L}}\p{{N}}_]', '[email]', 'g'),
        'https?://\S+|www\.\S+', '[url]', 'g'), '(^|[^\p{{L}}\p{{N}}_])@[A-Za-z0-9_.]{{2,}}', '\1[mention]', 'g'), '(?:\+?\d[\s.\-]?){{9,}}\d', '[tel]', 'g')"""
_CLEAN = (
    "translate(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    + _MASKED.format(x=r"regexp_replace(nfc_normalize(coalesce(text, '')), '[\x{00A0}\x{202F}\x{2007}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')")
    + r""", '!{3,}', '!', 'g'), '\?{3,}', '?', 'g'), '\.{3,}', '.', 'g'), ',{3,}', ',', 'g'), '\s+', ' ', 'g')), '’“”–—', '''""--')"""
)


@C.query(f"SELECT doc_id, {_MASKED.format(x='text')} AS masked FROM documents")
def mask_pii(spark, d):
    """Personal data of each contribution masked."""
    return read(spark, d, "documents").select("doc_id", text.mask_pii(F.col("text")).alias("masked"))


@C.query(f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def clean_text(spark, d):
    """Normalised contributions."""
    return read(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@C.query(rf"""SELECT source, count(*) AS n, CAST(sum(len(regexp_extract_all(m, '\[email\]'))) AS BIGINT) AS emails, CAST(sum(len(regexp_extract_all(m, '\[tel\]'))) AS BIGINT) AS phones,
    CAST(sum(len(regexp_extract_all(m, '\[url\]'))) AS BIGINT) AS urls FROM (SELECT source, {_MASKED.format(x="text")} AS m FROM documents) GROUP BY source""")
def pii_counts(spark, d):
    """Marks of personal data by source."""
    count = lambda mark: F.sum(F.size(F.regexp_extract_all("m", F.lit(rf"(\[{mark}\])"), 1))).cast("long")
    return read(spark, d, "documents").select("source", text.mask_pii(F.col("text")).alias("m")).groupBy("source").agg(F.count("*").alias("n"), count("email").alias("emails"), count("tel").alias("phones"), count("url").alias("urls"))


@C.query("SELECT doc_id, length(text) < 40 OR length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 30 AS empty_like FROM documents")
def empty_like(spark, d):
    """Contributions too short to say anything (with raised bounds, so that some are)."""
    return read(spark, d, "documents").select("doc_id", text.empty_like(F.col("text"), 40, 30).alias("empty_like"))


@C.query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 60) AS head FROM documents),
    c AS (SELECT *, regexp_replace(CASE WHEN instr(head, ' ') > 0 THEN regexp_replace(head, ' [^ ]*$', '') ELSE head END, '[,;:.\\- ]+$', '') AS cut FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(CASE WHEN cut = '' THEN head ELSE cut END) || '…' END AS label FROM c""")
def make_label(spark, d):
    """Short labels cut at a word."""
    return read(spark, d, "documents").select("doc_id", text.label(F.col("text"), 60).alias("label"))


@C.query("SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(source || ' ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug FROM documents")
def slug(spark, d):
    """Slugs of source and language."""
    return read(spark, d, "documents").select("doc_id", text.slug(F.concat("source", F.lit(" "), "lang", F.lit("!"))).alias("slug"))


@C.query(f"SELECT doc_id, substr(sha256('{SALT}|' || source || '|' || CAST(doc_id AS VARCHAR)), 1, 16) AS author_hash FROM documents")
def author_hash(spark, d):
    """Salted hashes of authors (the document's id stands for the author)."""
    return read(spark, d, "documents").select("doc_id", text.author_hash(F.col("source"), F.col("doc_id").cast("string"), SALT).alias("author_hash"))


@C.query(_lang_sql())
def lang_guess(spark, d):
    """Language by function words, beside the stored one."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", "lang").join(lang.guesses(docs, "doc_id", "text"), "doc_id")


@C.query(f"WITH x AS ({_lang_sql()}) SELECT lang, guess, count(*) AS n FROM x GROUP BY lang, guess")
def lang_confusion(spark, d):
    """Stored against guessed language."""
    return lang_guess(spark, d).groupBy("lang", "guess").agg(F.count("*").alias("n"))


@C.query("SELECT doc_id, least(1.0, (" + " + ".join(f"CAST(contains(lower(text), '{m}') AS INTEGER)" for m in text.REASON_MARKS) + " + CAST(regexp_matches(text, '[0-9]') AS INTEGER)) / 2.0) AS bonus FROM documents")
def reasoning_bonus(spark, d):
    """Bonus of contributions that give reasons."""
    return read(spark, d, "documents").select("doc_id", text.reasoning_bonus(F.col("text")).alias("bonus"))


@C.query("SELECT doc_id, round(CASE WHEN n <= 0 THEN 0.0 WHEN n < 200 THEN n / 200.0 WHEN n <= 1200 THEN 1.0 ELSE 1200.0 / n END, 6) AS readability FROM (SELECT doc_id, length(text) AS n FROM documents)")
def readability(spark, d):
    """Readability window of contributions."""
    return read(spark, d, "documents").select("doc_id", F.round(text.readability(F.length("text")), 6).alias("readability"))


@C.query("SELECT doc_id, CASE WHEN lang IS NULL OR lang IN ('', 'und') THEN guess ELSE lang END AS lang FROM (" + _lang_sql() + ")")
def language_resolution(spark, d):
    """The stored language unless blank or undetermined, else the guess."""
    known = F.nullif(F.nullif(F.col("lang"), F.lit("")), F.lit("und"))
    return lang_guess(spark, d).select("doc_id", F.coalesce(known, "guess").alias("lang"))


@C.query("SELECT doc_id, replace(strip_accents(lower(text)), 'ß', 'ss') AS folded FROM documents")
def fold_text(spark, d):
    """Contributions without accents and case, as search reads them."""
    return read(spark, d, "documents").select("doc_id", text.fold("text").alias("folded"))


QUERIES, ORACLES = C.queries, C.oracles
