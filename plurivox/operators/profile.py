"""Profile of string columns: statistics in one pass, and their kind by statistics alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed shapes and thresholds of the column kinds.
DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$|^\d{2}/\d{2}/\d{4}( \d{2}:\d{2}(:\d{2})?)?$"
NUMERIC = r"^-?\d+([.,]\d+)?$"
DATE_SHARE, NUMERIC_SHARE = 0.90, 0.95
OPEN_ANSWERS, OPEN_LONG, OPEN_SHORT = 10, 60, 25
OPEN_DISTINCT, OPEN_DISTINCT_FLOOR = 0.5, 0.05
OPEN_MAX_LEN, OPEN_DISTINCT_ROWS, DISTINCT_CAP = 500, 100, 50_000


def melt(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys, question_index, question, answer: one row for each non-blank answer; columns keep their place as index."""
    cells = F.array(*(F.struct(F.lit(i).alias("question_index"), F.lit(c).alias("question"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("answer")) for i, c in enumerate(columns)))
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("answer is not null")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics and kind of each column. The distinct count that is shown saturates at DISTINCT_CAP; the ratio is that of all distinct answers."""
    cells = F.array(*(F.struct(F.lit(i).alias("question_index"), F.lit(c).alias("question"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("answer")) for i, c in enumerate(columns)))
    long = df.select(F.explode(cells).alias("c")).select("c.*")
    # two levels: the first groups answers, so the distinct count needs no set in memory
    answers = long.groupBy("question_index", "question", "answer").agg(F.count("*").alias("n"))
    n = F.sum(F.when(F.col("answer").isNotNull(), F.col("n")).otherwise(0))
    size = F.length("answer")
    stats = answers.groupBy("question_index", "question").agg(
        n.alias("n_answers"),
        F.count("answer").alias("distinct"),
        F.least(F.count("answer"), F.lit(DISTINCT_CAP)).alias("n_distinct"),
        F.sum(size * F.col("n")).alias("total"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("max_len"),
        F.sum(F.when(F.col("answer").rlike(DATE), F.col("n")).otherwise(0)).alias("dates"),
        F.sum(F.when(F.col("answer").rlike(NUMERIC), F.col("n")).otherwise(0)).alias("numbers"),
    )
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n_answers"), F.lit(0)), F.lit(0.0))
    stats = stats.withColumn("distinct_ratio", share("distinct")).withColumn("avg_len", share("total"))
    return stats.select("question_index", "question", "n_answers", "n_distinct", F.round("distinct_ratio", 6).alias("distinct_ratio"), F.round("avg_len", 4).alias("avg_len"), "max_len", kind(share("dates"), share("numbers")).alias("kind"))


def kind(dates: Column, numbers: Column) -> Column:
    """Kind from n_answers, n_distinct, distinct_ratio, avg_len and max_len, and the shares of dates and numbers."""
    n, ratio, size = F.col("n_answers"), F.col("distinct_ratio"), F.col("avg_len")
    long_and_varied = (size >= OPEN_LONG) & (ratio >= OPEN_DISTINCT_FLOOR)
    very_varied = (size >= OPEN_SHORT) & (ratio >= OPEN_DISTINCT)
    repeated = (size >= OPEN_SHORT) & (F.col("max_len") >= OPEN_MAX_LEN) & (F.col("n_distinct") >= OPEN_DISTINCT_ROWS)
    return (
        F.when(n == 0, "empty").when(dates >= DATE_SHARE, "date").when(numbers >= NUMERIC_SHARE, "numeric")
        .when((n >= OPEN_ANSWERS) & (long_and_varied | very_varied | repeated), "open_text").otherwise("closed")
    )
