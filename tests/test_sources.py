"""Raw files: formats, archives, declared sources, and their errors."""

import json
import zipfile

import pytest

from plurivox.sources import archives, raw


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{path}"


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return f"file://{path}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bare_json(spark, tmp_path):
    df = raw.load(spark, put(tmp_path / "t.json", json.dumps([{"a": "1", "b": "x"}, {"b": "y", "c": "z"}])), "json")
    assert df.columns == ["a", "b", "c"] and set(rows(df.na.fill("-"))) == {("1", "x", "-"), ("-", "y", "z")}


def test_control_characters(spark, tmp_path):
    assert rows(raw.load(spark, put(tmp_path / "t.json", '[{"t": "one\ntwo\tthree"}]'), "json")) == [("one\ntwo\tthree",)]


def test_json_lines_instead_of_a_document(spark, tmp_path):
    path = put(tmp_path / "t.json", '{"a": "x", "b": {"$oid": "1"}}\n{"a": "y"}\n')
    assert raw.json_kind(spark, path) == "lines"
    df = raw.load(spark, path, "json")
    assert df.columns == ["a", "b.$oid"] and set(df.na.fill("-").collect()) == {("x", "1"), ("y", "-")}


def test_lines_and_documents_with_long_first_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "SNIFF_BYTES", 64)
    record = json.dumps({"a": "x" * 500})
    assert raw.json_kind(spark, put(tmp_path / "l.json", f"{record}\n{record}\n")) == "lines"
    assert raw.json_kind(spark, put(tmp_path / "d.json", f"  {record}\n")) == "document"
    monkeypatch.setattr(raw, "MOST_HEAD", 64)
    assert raw.json_kind(spark, put(tmp_path / "m.json", f"{record}\n{record}\n")) == "document"


def test_object_root_with_lists(spark, tmp_path):
    data = {"c": {"title": "T", "themes": {"theme": [{"title": "1", "q": {"x": [{"t": "q1"}, {"t": "q2"}]}}, {"title": "2", "q": {"x": [{"t": "q3"}]}}]}}}
    df = raw.load(spark, put(tmp_path / "t.json", json.dumps(data)), "json")
    assert rows(df.select("`c.title`", "`c.themes.theme.title`", "`c.themes.theme.q.x.t`")) == [("T", "1", "q1"), ("T", "1", "q2"), ("T", "2", "q3")]


@pytest.mark.parametrize("data", ['"a text"', "12", "", "   ", "nothing", '{"a": '])
def test_other_roots_are_rejected(spark, tmp_path, data):
    with pytest.raises(raw.LoaderError):
        raw.load(spark, put(tmp_path / "t.json", data), "json")


def test_single_json_member(spark, tmp_path):
    path = zipped(tmp_path / "a.json.zip", {"in/ART.JSON": '[{"d": "1", "t": "x"}, {"d": "2", "t": "y"}]', "read.me": "no"})
    assert rows(raw.load(spark, path, "json_zip", f"file://{tmp_path}/out/a.json")) == [("1", "x"), ("2", "y")]


@pytest.mark.parametrize("members", [{"dump.sql": "CREATE"}, {"a.json": "[]", "b.json": "[]"}, {}])
def test_other_members_are_rejected(spark, tmp_path, members):
    path = zipped(tmp_path / "a.zip", members)
    with pytest.raises(raw.LoaderError, match="sql" if "dump.sql" in members else "member"):
        raw.load(spark, path, "json_zip", f"file://{tmp_path}/out.json")


def test_broken_archives_and_formats(spark, tmp_path):
    with pytest.raises(raw.LoaderError, match="broken"):
        raw.load(spark, put(tmp_path / "a.zip", "no zip"), "json_zip", f"file://{tmp_path}/out.json")
    with pytest.raises(raw.LoaderError, match="unsupported"):
        raw.load(spark, "x", "xml_zip")
    with pytest.raises(raw.LoaderError):
        raw.load(spark, f"file://{tmp_path}/none.csv", "csv")


def test_lines_of_members_in_batches(spark, tmp_path, monkeypatch):
    data = {f"{k}.jsonl": "".join(f"{k}-{n}\n" for n in range(50 * k)) for k in range(4)} | {"other.txt": "no\n"}
    path = zipped(tmp_path / "a.zip", data)
    df = archives.read_lines(spark, path, ".jsonl")
    assert df.rdd.getNumPartitions() == 4
    assert rows(df) == sorted((f"{k}.jsonl", n, f"{k}-{n}") for k in range(4) for n in range(50 * k))
    assert {r["member"] for r in archives.read_lines(spark, path, "", ["2.jsonl", "absent"]).collect()} == {"2.jsonl"}
    assert archives.read_lines(spark, f"file://{tmp_path}/none.zip").collect() == []


def test_folder_of_dialects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.csv", "id;t\n1;“é” €\n".encode("cp1252"))
    put(tmp_path / "in" / "b.csv", "id,t,u\n2,ü,x\n")
    put(tmp_path / "in" / "_hidden", "x")
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    df = raw.read_csv(spark, f"file://{tmp_path}/in")
    assert {tuple(r) for r in df.select("id", "t", "u").collect()} == {("1", "“é” €", None), ("2", "ü", "x")}
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


LINES = ['{"id": 1, "text": " one ", "lang": "fr", "n": {"a": 1}}', "", "no json", '["list"]', '{"id": "2", "text": "two", "kind": "b", "w": "x"}', '{"id": 3, "text": ""}', '{"text": "four", "w": 2.5}']


@pytest.mark.parametrize("archive", [None, "zip"])
def test_declared_json_lines(spark, tmp_path, archive):
    path = zipped(tmp_path / "a.zip", {"x.jsonl": "\n".join(LINES), "y.txt": LINES[0]}) if archive else put(tmp_path / "a.jsonl", "\n".join(LINES))
    s = raw.Source("demo", path, {"id": "id", "text": "text", "lang": "lang", "weight": "w"}, format="jsonl", archive=archive, props={"kind": "kind", "nested": "n"})
    got = sorted((r["text"], r["raw_id"] if r["text"] != "four" else len(r["raw_id"]), r["lang"], r["weight"], tuple(sorted(r["props"].items()))) for r in s.read(spark).collect())
    assert got == [("four", 32, "und", 2.5, ()), ("one", "1", "fr", 1.0, (("nested", '{"a":1}'),)), ("two", "2", "und", 1.0, (("kind", "b"),))]
    s.lang_keep, s.keep_where = ["und"], {"kind": ["b"]}
    assert [r["text"] for r in s.read(spark).collect()] == ["two"]


def test_missing_sources_and_columns_by_index(spark, tmp_path):
    for kind in ({"format": "csv"}, {"format": "jsonl"}, {"format": "jsonl", "archive": "zip"}):
        s = raw.Source("none", f"file://{tmp_path}/none", {"text": "t"}, **kind)
        assert s.read(spark).collect() == [] and s.read(spark).columns == ["raw_id", "text", "author", "source", "ts", "lang", "weight"]
    path = put(tmp_path / "a.csv", "1|été\n2|b\n".encode("cp1252"))
    s = raw.Source("bare", path, {"id": 0, "text": 1}, {"0": ["1"]}, delimiter="|", encoding="windows-1252", has_header=False)
    assert [(r["raw_id"], r["text"]) for r in s.read(spark).collect()] == [("1", "été")]
    with pytest.raises(ValueError):
        raw.Source("x", "y", {"text": "t"}, format="xml")


def test_discovered_descriptors(spark, tmp_path):
    put(tmp_path / "a.csv", "t\nx\n")
    (tmp_path / "d").mkdir()
    for name in ("two", "one"):
        put(tmp_path / "d" / f"{name}.json", json.dumps({"name": name, "path": f"file://{tmp_path}/a.csv", "columns": {"text": "t"}}))
    put(tmp_path / "d" / "note.txt", "no")
    found = raw.discover(spark, f"file://{tmp_path}/d")
    assert [s.name for s in found] == ["one", "two"]
    assert rows(raw.read_all(spark, found).select("source", "text")) == [("one", "x"), ("two", "x")]
