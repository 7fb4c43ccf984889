"""Language guess by counts of function words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words of each language; the order of the languages decides ties.
FUNCTION_WORDS = {
    "fr": "le la les de des et est que pour pas une un je ne sur qui dans plus ce il",
    "en": "the and is of to that for not with this you are it on they we have but as be",
    "de": "der die das und ist nicht ein eine zu mit auf den von wir es auch für dem",
    "es": "el la los las de que no por para con una uno es en se su lo como más pero",
    "pt": "o a os as de que não por para com uma um é em se do da como mais mas",
    "it": "il lo la le di che non per con una uno è in si del della come più ma sono",
    "nl": "de het een en van is niet dat op te met voor die in zijn ook maar om aan we",
}


def guess(text: Column) -> Column:
    """Code of the language with most function words, `und` without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    counts = [F.struct(hits(ws.split()).alias("n"), F.lit(-k).alias("k"), F.lit(code).alias("code")) for k, (code, ws) in enumerate(FUNCTION_WORDS.items())]
    # one reference to the counts, so that they are not worked out again for each language; `und` wins where all are 0
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("k"), F.lit("und").alias("code"))
    return F.when(F.length(F.trim(text)) >= 3, F.array_max(F.array(none, *counts))["code"]).otherwise("und")


def guesses(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, guess of the texts of a table whose keys are not repeated: as `guess` says, but words meet the function words in one join instead of one look
    at each word a language, and only counts by key and language are shuffled."""
    words = df.where(F.length(F.trim(text)) >= 3).select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)).alias("w"))
    known = [(w, k, code) for k, (code, ws) in enumerate(FUNCTION_WORDS.items()) for w in ws.split()]
    fixed = df.sparkSession.createDataFrame(known, "w string, k int, code string")
    hits = words.join(F.broadcast(fixed), "w").groupBy(key, "k", "code").agg(F.count("*").alias("n"))
    best = hits.groupBy(key).agg(F.max(F.struct("n", (-F.col("k")).alias("k"), "code")).alias("b")).select(key, F.col("b.code").alias("_code"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce("_code", F.lit("und")).alias("guess"))
