"""Kept state: build statuses folded from updates, signatures that tell stale results, and rate counters, for batches and for replayable streams.

Folding is associative, so a state is an update like any other: the state after a batch is the fold of the state before it and the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .events import Store

ABSENT, BUILDING, READY, ERROR = "absent", "building", "ready", "error"
_FIELDS = "map<string, struct<seq: long, value: string>>"
UPDATE = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
STATE = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", T.StringType())])))])


def _as_state(updates: DataFrame) -> DataFrame:
    stamped = F.transform_values(F.coalesce("fields", F.create_map().cast("map<string, string>")), lambda k, v: F.struct(F.col("seq").alias("seq"), v.alias("value")))
    return updates.select("dataset", "seq", "status", stamped.alias("fields"))


def fold(state: DataFrame) -> DataFrame:
    """dataset, seq, status, fields: the latest status of each dataset, and of each field its latest value; fields that later updates do not name stay.

    Rows of one dataset are combined before they are shuffled: by dataset for the status, by dataset and field for the fields. Of equal `seq` the
    greater status and value count."""
    last = state.groupBy("dataset").agg(F.max(F.struct("seq", "status")).alias("s"))
    each = state.select("dataset", F.explode("fields").alias("name", "f")).groupBy("dataset", "name").agg(F.max("f").alias("f"))
    fields = each.groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "f")))).alias("fields"))
    empty = F.create_map().cast(_FIELDS)
    return last.join(fields, "dataset", "left").select("dataset", "s.seq", "s.status", F.coalesce("fields", empty).alias("fields"))


def fold_updates(updates: DataFrame) -> DataFrame:
    """The state after `updates` (dataset, seq, status, fields)."""
    return fold(_as_state(updates))


def effective(state: DataFrame, artefacts: DataFrame, datasets: DataFrame) -> DataFrame:
    """dataset, status, fields map<string, string> of every dataset: `ready` only where its artefact exists, `absent` without a state."""
    known = artefacts.select("dataset", F.lit(True).alias("_there")).distinct()
    rows = datasets.select("dataset").distinct().join(state, "dataset", "left").join(known, "dataset", "left")
    status = F.when(F.col("status").isNull() | ((F.col("status") == READY) & F.col("_there").isNull()), ABSENT).otherwise(F.col("status"))
    values = F.transform_values(F.coalesce("fields", F.create_map().cast(_FIELDS)), lambda k, v: v["value"])
    return rows.select("dataset", status.alias("status"), values.alias("fields"))


class StatusTable:
    """A state by epoch in a folder: epoch=<n> holds the state after that batch, so a replayed batch folds into the same state before it."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path, STATE)

    def after(self, run: str, epoch: int) -> DataFrame:
        """The state after the last batch up to `epoch`."""
        rows = self.store.read().where((F.col("run") == run) & (F.col("epoch") <= epoch))
        last = rows.agg(F.max("epoch")).first()[0]
        return rows.where(F.col("epoch") == (-1 if last is None else last)).drop("run", "epoch")

    def take(self, updates: DataFrame, run: str, epoch: int) -> None:
        self.store.append(fold(self.after(run, epoch - 1).unionByName(_as_state(updates))), run, epoch)


def run_statuses(stream: DataFrame, table: StatusTable, checkpoint: str, run: str = "live"):
    """Start a stream of status updates into the table. A batch without rows leaves no epoch."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            table.take(batch, run, epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def signatures(parts: DataFrame, key: str) -> DataFrame:
    """key, signature: a hash of the sorted parts (key, name, size) of each key; a part that is missing has size -1."""
    listed = F.array_sort(F.collect_list(F.struct("name", F.coalesce("size", F.lit(-1).cast("long")).alias("size"))))
    text = F.concat_ws("\x00", F.transform(listed, lambda p: F.concat_ws("\x01", p["name"], p["size"].cast("string"))))
    return parts.groupBy(key).agg(F.sha2(text, 256).alias("signature"))


def staleness(kept: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, state of every key of `kept` or `current` (key, signature): valid, changed, new (nothing kept) or gone (no source any more)."""
    both = kept.select(key, F.col("signature").alias("_kept")).join(current.select(key, F.col("signature").alias("_now")), key, "full")
    state = F.when(F.col("_kept").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_kept") == F.col("_now"), "valid").otherwise("changed")
    return both.select(key, state.alias("state"))


def refreshed(results: DataFrame, current: DataFrame, key: str, build) -> DataFrame:
    """`results` (key, signature, ...) brought up to date: valid rows stay, `build(keys)` gives the rows of new and changed keys without their
    signature, rows of keys that are gone are left out."""
    states = staleness(results.select(key, "signature").distinct(), current, key)
    held = results.join(states.where("state = 'valid'").select(key), key, "left_semi")
    made = build(states.where("state in ('new', 'changed')").select(key)).join(current.select(key, "signature"), key)
    return held.unionByName(made)
