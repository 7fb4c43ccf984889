"""Evaluation of clusterings, classifications and segmentations from contingency counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sums(table: DataFrame) -> DataFrame:
    """One row: n, entropies of prediction, truth and both, pairs together in each and in both."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    rows, cols = table.groupBy("pred").agg(F.sum("n").alias("n")), table.groupBy("truth").agg(F.sum("n").alias("n"))
    total = table.agg(F.sum("n").alias("total"))
    entropy = -F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total")))
    parts = [x.crossJoin(F.broadcast(total)).agg(entropy.alias(f"h_{s}"), pairs("n").alias(f"p_{s}")) for s, x in (("both", table), ("pred", rows), ("truth", cols))]
    return total.crossJoin(parts[0]).crossJoin(parts[1]).crossJoin(parts[2])  # four single rows


def clustering(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """One row: purity, nmi, ari, homogeneity, completeness and v_measure."""
    table = rows.groupBy(F.col(pred).alias("pred"), F.col(truth).alias("truth")).agg(F.count("*").alias("n"))
    purity = table.groupBy("pred").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("purity"))
    s = _sums(table).crossJoin(purity)
    mutual = F.col("h_pred") + F.col("h_truth") - F.col("h_both")
    hom = F.when(F.col("h_truth") > 0, mutual / F.col("h_truth")).otherwise(1.0)
    com = F.when(F.col("h_pred") > 0, mutual / F.col("h_pred")).otherwise(1.0)
    expected = F.col("p_pred") * F.col("p_truth") / (F.col("total") * (F.col("total") - 1) / 2)
    ari = (F.col("p_both") - expected) / ((F.col("p_pred") + F.col("p_truth")) / 2 - expected)
    nmi = mutual / ((F.col("h_pred") + F.col("h_truth")) / 2)
    v = F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(0.0)
    return s.select(*(F.round(x, 6).alias(n) for n, x in (("purity", F.col("purity")), ("nmi", nmi), ("ari", ari), ("homogeneity", hom), ("completeness", com), ("v_measure", v))))


def classification(rows: DataFrame, pred: str, truth: str, positive) -> DataFrame:
    """One row: counts, precision, recall, f1, accuracy over decided rows, and the share left undecided (null prediction)."""
    p, t = F.col(pred) == positive, F.col(truth) == positive
    s = rows.agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(F.col(pred).isNotNull() & ~p & t).alias("fn"),
        F.count_if(F.col(pred).isNotNull() & ~p & ~t).alias("tn"), F.count_if(F.col(pred).isNull()).alias("undecided"), F.count("*").alias("n"),
    )
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(F.col("undecided"), F.col("n")).alias("abstention"))


def eta_squared(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the share of the variance of a value that its group explains."""
    per = rows.groupBy(group).agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.col(value).cast("double") * F.col(value)).alias("q"))
    total = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    return total.select(F.round((F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("q") - F.col("s") * F.col("s") / F.col("n")), 6).alias("eta_squared"))


def segments(rows: DataFrame, doc: str, pos: str, boundary: Column) -> DataFrame:
    """rows with `segment`: running count of boundaries within each document."""
    return rows.withColumn("segment", F.sum(boundary.cast("int")).over(W.partitionBy(doc).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)))


def pk_window_diff(rows: DataFrame, doc: str, pos: str, k: int) -> DataFrame:
    """doc, pk, window_diff of `ref` and `hyp` boundaries (0 / 1) at lag k."""
    order = W.partitionBy(doc).orderBy(pos)
    window = order.rowsBetween(1, k)
    seg = rows.withColumn("r", F.sum("ref").over(order)).withColumn("h", F.sum("hyp").over(order)).withColumn("r2", F.lead("r", k).over(order)).withColumn("h2", F.lead("h", k).over(order)).withColumn("rb", F.sum("ref").over(window)).withColumn("hb", F.sum("hyp").over(window))
    seg = seg.where("r2 is not null")
    return seg.groupBy(doc).agg(F.round(F.avg(((F.col("r") == F.col("r2")) != (F.col("h") == F.col("h2"))).cast("double")), 6).alias("pk"), F.round(F.avg((F.col("rb") != F.col("hb")).cast("double")), 6).alias("window_diff"))


def cooccurrence(rows: DataFrame, item: str, theme: str) -> DataFrame:
    """a < b, n: items that hold both themes. An item's distinct themes become one array, so a join by item is not needed;
    its pairs are few as themes in one item are."""
    sets = rows.groupBy(item).agg(F.array_sort(F.collect_set(theme)).alias("ts")).where(F.size("ts") > 1)
    firsts = sets.select("ts", F.posexplode("ts").alias("i", "a"))
    return firsts.select("a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def copeland(duels: DataFrame, winner: str, loser: str) -> DataFrame:
    """name, wins, losses, net: pairwise majority wins less losses."""
    ways = duels.groupBy(F.col(winner).alias("x"), F.col(loser).alias("y")).agg(F.count("*").alias("n"))
    back = ways.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("n").alias("m"))
    both = ways.join(back, ["x", "y"], "full").select("x", "y", F.sign(F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).alias("s"))
    return both.groupBy(F.col("x").alias("name")).agg(F.count_if(F.col("s") > 0).alias("wins"), F.count_if(F.col("s") < 0).alias("losses"), F.sum("s").cast("long").alias("net"))


def composite(rows: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key, score: min-max scaled measures, a negative weight where lower is better."""
    ranges = rows.agg(*(F.min(c).alias(f"lo_{c}") for c in weights), *(F.max(c).alias(f"hi_{c}") for c in weights))
    total = sum(abs(w) for w in weights.values())
    score = F.lit(0.0)
    for c, w in weights.items():
        scaled = F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0)), F.lit(0.0))
        score = score + (scaled if w > 0 else 1 - scaled) * (abs(w) / total)
    return rows.crossJoin(F.broadcast(ranges)).select(key, F.round(score, 6).alias("score"))
