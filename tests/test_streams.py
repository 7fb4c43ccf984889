import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from plurivox.streaming import events, state


def test_tumbling_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 0, 0)
    rows = [(i, t + dt.timedelta(minutes=7 * i), "ab"[i % 2], 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string, value double")
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = events.tumbling(stream, "ts", ["event_type"], "1 hour", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, events.tumbling(df, "ts", ["event_type"], "1 hour").collect()))


def test_first_seen_on_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "k int, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    q = events.first_seen(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", ["k"]).writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == [1, 2]


def plain(store, batch, bound=0.68):
    """(before, close, top) of each submission of a batch in the order of (ts, text)."""
    known, out = list(store), []
    for r in sorted(batch, key=lambda r: (r[1], r[0])):
        sims = [float(np.dot(r[2], k[2])) for k in known if r[2] and k[2] and len(r[2]) == len(k[2])]
        out.append((len(known), sum(c >= bound for c in sims), round(max(sims), 6) if sims else None))
        known.append(r)
    return out


def submission(rng, k, day):
    v = rng.normal(size=3)
    return (f"t{k}", dt.datetime(2024, 1, day, 0, k % 7), None if k % 5 == 0 else [float(np.float32(x)) for x in v / np.linalg.norm(v)] if k % 11 else [1.0])


def test_submissions_are_correlated_with_all_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(events, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(3)
    seed, days = [submission(rng, k, 1) for k in range(12)], [[submission(rng, 20 * d + k, d) for k in range(11)] for d in (2, 3)]
    store = events.Store(spark, f"{tmp_path}/store")
    assert store.count() == 0
    store.append(spark.createDataFrame(seed, events.SUBMISSION), "seed", 0)
    got = {}

    def start():
        stream = events.submissions(spark, f"{tmp_path}/live")
        return events.run_submissions(stream, store, lambda df, epoch: got.__setitem__(epoch, [(r["before"], r["close"], r["top"]) for r in df.collect()]), f"{tmp_path}/cp")

    for n, day in enumerate(days):  # the stream is stopped and started again between the batches
        spark.createDataFrame(day, events.SUBMISSION).coalesce(1).write.mode("append").json(f"{tmp_path}/live")
        q = start()
        q.processAllAvailable()
        q.stop()
        assert store.count() == 12 + 11 * (n + 1)
    close = lambda a, b: a[:2] == b[:2] and (a[2] == b[2] or abs(a[2] - b[2]) < 1e-5)
    assert all(map(close, got[0], plain(seed, days[0]))) and all(map(close, got[1], plain(seed + sorted(days[0]), days[1])))
    # a replay of the last batch, as after a crash before its commit
    first, commits = dict(got), sorted(p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    q = start()
    q.processAllAvailable()
    q.stop()
    assert got == first and store.count() == 34


def test_statuses_fold_in_any_grouping(spark, tmp_path):
    updates = [("a", 1, "building", {"done": "1", "total": "9"}), ("a", 3, "ready", {"done": "9"}), ("a", 2, "building", {"done": "5", "phase": "x"}), ("b", 1, "error", None), ("c", 1, "ready", {})]
    df = spark.createDataFrame(updates, state.UPDATE)
    table = state.StatusTable(spark, f"{tmp_path}/status")
    table.take(df.where("seq = 1"), "r", 0)
    table.take(df.where("seq > 1"), "r", 1)
    table.take(df.where("seq > 1"), "r", 1)  # a replay
    whole = state.fold_updates(df)
    plain_rows = lambda x: sorted((r["dataset"], r["seq"], r["status"], sorted((k, v["value"]) for k, v in r["fields"].items())) for r in x.collect())
    assert plain_rows(table.after("r", 1)) == plain_rows(whole) == [("a", 3, "ready", [("done", "9"), ("phase", "x"), ("total", "9")]), ("b", 1, "error", []), ("c", 1, "ready", [])]
    names = spark.createDataFrame([(x,) for x in "abcd"], "dataset string")
    got = {r["dataset"]: r["status"] for r in state.effective(whole, names.where("dataset = 'a'"), names).collect()}
    assert got == {"a": "ready", "b": "error", "c": "absent", "d": "absent"}


def test_status_stream_survives_a_restart(spark, tmp_path):
    table = state.StatusTable(spark, f"{tmp_path}/status")
    for n in range(3):
        spark.createDataFrame([("a", n, ["building", "error", "ready"][n], {f"f{n}": "x"})], state.UPDATE).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = state.run_statuses(spark.readStream.schema(state.UPDATE).json(f"{tmp_path}/in"), table, f"{tmp_path}/cp")
        q.processAllAvailable()
        q.stop()
    row = table.after("live", 99).first()
    assert row["status"] == "ready" and sorted(row["fields"]) == ["f0", "f1", "f2"]


def test_signatures_invalidate(spark):
    parts = lambda rows: state.signatures(spark.createDataFrame(rows, "k string, name string, size long"), "k")
    kept, now = parts([("a", "x", 1), ("a", "y", None), ("b", "x", 2), ("c", "x", 3)]), parts([("a", "y", -1), ("a", "x", 1), ("b", "x", 5), ("d", "x", 1)])
    assert {r["k"]: r["state"] for r in state.staleness(kept, now, "k").collect()} == {"a": "valid", "b": "changed", "c": "gone", "d": "new"}
    results, asked = kept.withColumn("v", F.lit("old")), []

    def build(keys):
        asked.extend(sorted(r["k"] for r in keys.collect()))
        return keys.withColumn("v", F.lit("made"))

    new = state.refreshed(results, now, "k", build)
    assert {r["k"]: r["v"] for r in new.collect()} == {"a": "old", "b": "made", "d": "made"} and asked == ["b", "d"]
    assert {r["state"] for r in state.staleness(new.select("k", "signature"), now, "k").collect()} == {"valid"}
