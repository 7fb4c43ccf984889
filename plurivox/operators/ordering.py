"""Places of rows in a total order, without a window that holds them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str | Column], name: str, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` with `name`: each row's place (from 0) in `order`, which should be total. Rows are sorted over range partitions and written; a place is
    that in the partition plus the rows of the partitions before, a table of one row a partition."""
    rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part, inside = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(starts), part == F.col("_part")).select(*df.columns, (F.col("_before") + inside).alias(name))


def numbered_within(df: DataFrame, group: str, order: list[str], name: str, count: str, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` with `name`, each row's place (from 0) in its group in `order`, which should be total there, and `count`, the rows of the group. No task holds a group:
    places come from range partitions, and from the rows of the group in the partitions before, a table of one row a group and partition."""
    rows = checkpoint(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    runs = rows.groupBy(F.col(group).alias("_of"), part.alias("_part")).agg(F.min(name).alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_of").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = runs.groupBy(F.col("_of").alias("_whole")).agg(F.sum("_n").alias(count))
    runs = runs.withColumn("_before", before).join(totals, F.col("_of").eqNullSafe(F.col("_whole")))
    joined = rows.join(runs, F.col(group).eqNullSafe(F.col("_of")) & (part == F.col("_part")))
    return joined.select(*df.columns, (F.col(name) - F.col("_first") + F.col("_before")).alias(name), count)
