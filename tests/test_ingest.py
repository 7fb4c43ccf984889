import json

import pytest
from pyspark.sql import functions as F

from plurivox.operators import ingest, opinion, profile, spans, tree
from plurivox.sources import raw


def kinds(spark, columns):
    names = list(columns)
    n = max(map(len, columns.values()))
    rows = [tuple(columns[c][i] if i < len(columns[c]) else None for c in names) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    return {r["question"]: r for r in profile.profile(df, names).collect()}


def test_column_kinds(spark):
    got = kinds(spark, {
        "id": [str(i) for i in range(20)], "date": ["2024-01-02T10:11:12"] * 20, "date_fr": ["02/01/2024"] * 20, "choice": ["yes", "no"] * 10,
        "story": [f"a long sentence number {i} that tells what somebody thinks about something" for i in range(20)], "blank": ["", " "] * 10,
    })
    assert {k: r["kind"] for k, r in got.items()} == {"id": "numeric", "date": "date", "date_fr": "date", "choice": "closed", "story": "open_text", "blank": "empty"}


def test_column_kind_edges(spark):
    label = "the very same long label that an export repeats in each of its many rows"
    assert kinds(spark, {"x": [label] * 200})["x"]["kind"] == "closed"
    assert kinds(spark, {"x": [f"{i} different short texts {i}" for i in range(30)]})["x"]["kind"] == "open_text"
    assert kinds(spark, {"x": ["a text that is copied very often"] * 300 + [f"a text of its own, number {i}" for i in range(120)] + ["y" * 501]})["x"]["kind"] == "open_text"
    assert kinds(spark, {"x": [f"quite a long answer of somebody, the {i}th of few, with more words" for i in range(3)]})["x"]["kind"] == "closed"
    r = kinds(spark, {"x": ["aa", "bb", "aa", ""]})["x"]
    assert (r["n_answers"], r["n_distinct"], r["avg_len"], r["max_len"]) == (3, 2, 2.0, 2)


def test_sniff():
    assert raw.sniff("a;b;c\n1;é;2\n".encode()) == ("utf-8", ";")
    assert raw.sniff("a,b\n1,é\n".encode("cp1252")) == ("windows-1252", ",")
    assert raw.sniff(b"x" * (raw.SNIFF_BYTES - 1) + "é".encode()) == ("utf-8", ";")


def test_csv_ragged_and_multiline(spark, tmp_path):
    (tmp_path / "a.csv").write_text('q;r\n1;"two\nlines"\n2\n3;x;extra\n', encoding="utf-8")
    rows = [tuple(r) for r in raw.read_csv(spark, f"file://{tmp_path}/a.csv").collect()]
    assert rows == [("1", "two\nlines"), ("2", None), ("3", "x")]


def test_csv_cp1252(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("q;r\n1;été\n".encode("cp1252"))
    assert raw.read_csv(spark, f"file://{tmp_path}/b.csv").first()["r"] == "été"


def test_json_flatten(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"Q": "a", "R": [{"r": 1}, {"r": 2}]}, {"Q": "b", "R": [{"r": 3}]}, {"Q": "c", "R": []}]))
    df = raw.read_json(spark, f"file://{tmp_path}/c.json")
    assert sorted(tuple(r) for r in raw.flatten(df).collect()) == [("a", "1"), ("a", "2"), ("b", "3")]
    assert raw.flatten_losses(df).first()["lost"] == 1


def test_json_records_without_lists(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"Q": "a", "R": [{"r": 1}, None], "S": {"t": [{"u": 5}]}}, {"Q": "nolist"}, {"Q": "null", "R": None}, {"Q": "empty", "R": []}]))
    df = raw.read_json(spark, f"file://{tmp_path}/e.json")
    got = raw.flatten(df)
    assert sorted((r["Q"], str(r[got.columns.index("R.r")]), str(r[got.columns.index("S.t.u")])) for r in got.collect()) == [("a", "1", "None"), ("a", "None", "5"), ("nolist", "None", "None"), ("null", "None", "None")]
    assert raw.flatten_losses(df).first()["lost"] == 1


def test_date_kinds(spark):
    kinds = {"a": "02/01/2024 10:11", "b": "2024-01-02T10:11:12", "c": "2024-01-02 10:11:12.5", "d": "2024-01-02T10:11Z", "e": "02/01/2024"}
    df = spark.createDataFrame([tuple(kinds.values())] * 12, list(kinds))
    assert {r["question"]: r["kind"] for r in profile.profile(df, list(kinds)).collect()} == {"a": "date", "b": "date", "c": "closed", "d": "closed", "e": "date"}


def test_source_descriptor(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id|w|text|kind\n1|2.5|hello there|a\n2|bad|good bye|b\n3|1|  |a\n")
    s = raw.Source("demo", f"file://{tmp_path}/d.csv", {"id": "id", "weight": "w", "text": "text"}, {"kind": ["a", "b"]}, "en", "|")
    assert [(r["raw_id"], r["text"], r["author"], r["lang"], r["weight"]) for r in s.read(spark).orderBy("raw_id").collect()] == [("1", "hello there", "1", "en", 2.5), ("2", "good bye", "2", "en", 1.0)]
    with pytest.raises(ValueError):
        raw.Source("mixed", "x", {"id": 0, "text": "text"})


def test_partition_replacement(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    raw.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "slug string, v int"), path, "slug")
    raw.replace_partitions(spark.createDataFrame([("a", 9)], "slug string, v int"), path, "slug")
    assert sorted((r["slug"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_exact_dedup_keeps_first_weight(spark):
    df = spark.createDataFrame([("x", 2, 5.0), ("x", 1, 3.0), ("y", 3, 1.0)], "t string, o int, w double")
    assert sorted((r["text"], r["o"], r["weight"]) for r in ingest.exact_dedup(df, "t", "o", F.col("w")).collect()) == [("x", 1, 4.0), ("y", 3, 1.0)]


def test_ratio_of_more_distinct_answers_than_are_shown(spark, monkeypatch):
    monkeypatch.setattr(profile, "DISTINCT_CAP", 50)
    text = spark.range(100).selectExpr("concat('an answer of some thirty letters ', id % 80) as a")
    row = profile.profile(text, ["a"]).first()
    assert (row["n_distinct"], row["distinct_ratio"], row["kind"]) == (50, 0.8, "open_text")


@pytest.mark.parametrize(("favour", "against", "nuanced", "profile"), [(5, 5, 2, "divided"), (9, 1, 0, "consensual"), (2, 0, 10, "unclear"), (3, 2, 0, "unclear")])
def test_opinion_profiles(spark, favour, against, nuanced, profile):
    rows = [("t", "favour")] * favour + [("t", "against")] * against + [("t", "nuanced")] * nuanced
    assert opinion.scored(opinion.split(spark.createDataFrame(rows, "theme string, stance string"), "theme", "stance")).first()["profile"] == profile


def test_majority_ties_by_name(spark):
    rows = spark.createDataFrame([("n", "b"), ("n", "a"), ("n", None)], "g string, v string")
    assert tuple(opinion.majority(rows, "g", "v").first()) == ("n", "a", 1, 0.5)


def test_tree_cycle_ends(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id int, parent int")
    assert tree.ancestors(nodes, "id", "parent").where("node = 3").count() == 1


def test_cover_and_gaps(spark):
    rows = spark.createDataFrame([("d", 100, 10, 20), ("d", 100, 15, 30), ("d", 100, 60, 70)], "k string, n int, start int, end int")
    assert sorted((r["start"], r["end"]) for r in spans.cover(rows, "k").collect()) == [(10, 30), (60, 70)]
    assert sorted((r["start"], r["end"]) for r in spans.uncovered(rows, "k", "n", 20).collect()) == [(30, 60), (70, 100)]
