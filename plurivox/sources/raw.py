"""Raw survey files: sniffed CSV, JSON of any shape flattened to rows, declared sources, and partitioned sinks."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import archives
from .archives import LoaderError

SNIFF_BYTES = 65_536
DELIMITERS = ";,\t"
#: Suffixes and their formats, the longest first.
FORMATS = ((".json.zip", "json_zip"), (".xml.zip", "xml_zip"), (".csv", "csv"), (".json", "json"), (".xml", "xml"), (".zip", "zip"))


def format_of(name: Column) -> Column:
    out = F.lit("other")
    for suffix, kind in reversed(FORMATS):
        out = F.when(F.lower(name).endswith(suffix), kind).otherwise(out)
    return out


def sniff(head: bytes) -> tuple[str, str]:
    """Encoding and delimiter from the first bytes of a CSV file; a character cut at the end does not count."""
    head, encoding = head[:SNIFF_BYTES], "windows-1252"
    for cut in range(4 if len(head) == SNIFF_BYTES else 1):
        try:
            head[: len(head) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
        encoding = "utf-8"
        break
    line = head.splitlines()[0].decode("latin-1") if head else ""
    return encoding, max(DELIMITERS, key=line.count)


def head(spark: SparkSession, path: str, size: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file, through Spark's own file systems; nothing beyond them is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder in order, without hidden ones; a file is itself. Empty where nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    found = [str(s.getPath()) for s in system.listStatus(at) if s.isFile()] if system.getFileStatus(at).isDirectory() else [path]
    return sorted(f for f in found if f.rsplit("/", 1)[-1][:1] not in "._")


#: Characters that windows-1252 has at 0x80 to 0x9F, where ISO-8859-1 has control characters; five places are empty.
_HIGH = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def csv_of(spark: SparkSession, path: str | list[str], delimiter: str, encoding: str = "utf-8", header: bool = True) -> DataFrame:
    """CSV files of one dialect as strings. Spark reads windows-1252 as ISO-8859-1, whose control characters are then put right."""
    wide = encoding.lower() in ("windows-1252", "cp1252")
    rows = spark.read.csv(path, sep=delimiter, encoding="ISO-8859-1" if wide else encoding, header=header, multiLine=True, mode="PERMISSIVE", quote='"', escape='"', inferSchema=False)
    if not wide:
        return rows
    put = str.maketrans(_HIGH)
    return rows.select(*(F.translate(F.col(f"`{c}`"), "".join(_HIGH), "".join(_HIGH.values())).alias(c.translate(put)) for c in rows.columns))


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV file or a folder of them as strings, each file in its own encoding and with its own delimiter; short rows are filled with nulls, long ones
    cut, and columns that a file lacks are null. Only heads of files reach the driver."""
    dialects: dict[tuple[str, str], list[str]] = {}
    for f in files(spark, path):
        dialects.setdefault(sniff(head(spark, f)), []).append(f)
    if not dialects:
        raise LoaderError(f"no CSV file at {path}")
    parts = [csv_of(spark, fs, delimiter, encoding, header) for (encoding, delimiter), fs in sorted(dialects.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Bytes of a first JSON record up to which a file is told to be lines or one document; with a longer one it is a document.
MOST_HEAD = 64 << 20


def json_kind(spark: SparkSession, path: str) -> str:
    """`document` or `lines` of a JSON file: lines when more follows a complete first object. An error for a scalar root, an empty file or a broken first object."""
    size = SNIFF_BYTES
    while True:
        raw = head(spark, path, size)
        text, whole = raw.decode("utf-8-sig", errors="ignore").lstrip(), len(raw) < size
        if not text or text[0] not in "[{":
            raise LoaderError(f"JSON objects expected: {path}")
        if text[0] == "[":
            return "document"
        try:
            _, end = json.JSONDecoder(strict=False).raw_decode(text)
            if text[end:].strip():
                return "lines"
            if whole:
                return "document"
        except json.JSONDecodeError as e:
            if whole:
                raise LoaderError(f"broken JSON: {path} ({e})") from e
        if size >= MOST_HEAD:
            return "document"
        size *= 8


def read_json(spark: SparkSession, path: str, document: bool | None = None) -> DataFrame:
    """A JSON document (`document`) or JSON lines, told by the file's head where it is not said; raw control characters are let through, records that are no
    objects fail."""
    if document is None:
        first = files(spark, path)
        if not first:
            raise LoaderError(f"no JSON file at {path}")
        document = json_kind(spark, first[0]) == "document"
    return spark.read.option("allowUnquotedControlChars", True).json(path, multiLine=document, mode="FAILFAST")


def read_json_zip(spark: SparkSession, path: str, target: str) -> DataFrame:
    """The single JSON member of an archive, unpacked to `target`."""
    return read_json(spark, archives.unpacked(spark, path, archives.single(path, ".json"), target))


def load(spark: SparkSession, path: str, kind: str, target: str | None = None) -> DataFrame:
    """A raw file of a known format as flat rows of strings; archives need a `target` to be unpacked to."""
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "json":
        return flatten(read_json(spark, path))
    if kind == "json_zip" and target:
        return flatten(read_json_zip(spark, path, target))
    raise LoaderError(f"unsupported format: {kind}")


def flatten(df: DataFrame, prefix: str = "") -> DataFrame:
    """Structs to dotted columns and lists to rows. Sibling lists are united, not crossed, each row with the scalars around
    it; a record whose lists are all empty gives no row (`flatten_losses` counts them)."""
    scalars: list[Column] = []
    lists: list[tuple[str, Column]] = []

    def visit(name: str, column: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(f"{name}.{f.name}" if name else f.name, column[f.name], f.dataType)
        elif isinstance(kind, T.ArrayType):
            lists.append((name, column))
        else:
            scalars.append(column.cast("string").alias(name))

    for f in df.schema.fields:
        visit(f.name, F.col(f"`{f.name}`"), f.dataType)
    if not lists:
        return df.select(*scalars)
    parts = []
    for name, column in lists:
        part = df.select(*scalars, F.explode(column).alias(name))
        parts.append(flatten(part.where(F.col(f"`{name}`").isNotNull())))
    parts.append(df.where(reduce(lambda a, b: a & b, [c.isNull() for _, c in lists])).select(*scalars))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def flatten_losses(df: DataFrame) -> DataFrame:
    """One row: records that flatten() drops because all their lists are empty."""
    lists = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    some = reduce(lambda a, b: a | b, [c.isNotNull() for c in lists], F.lit(False))
    empty = reduce(lambda a, b: a & b, [c.isNull() | (F.size(c) == 0) for c in lists], some)
    return df.agg(F.count_if(empty).alias("lost"))


@dataclass
class Source:
    """A declared source: where it lies and which of its columns mean what. `format` is csv or jsonl; a jsonl source may be an `archive` (zip) with `members`,
    all that end in .jsonl where none are named."""

    name: str
    path: str
    columns: dict[str, str | int]
    keep_where: dict[str, list[str]] = field(default_factory=dict)
    lang: str = "und"
    delimiter: str = ","
    format: str = "csv"
    encoding: str = "utf-8"
    has_header: bool = True
    archive: str | None = None
    members: list[str] = field(default_factory=list)
    lang_keep: list[str] = field(default_factory=list)
    props: dict[str, str | int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if "text" not in self.columns:
            raise ValueError("a source needs a text column")
        if len({type(c) for c in self.columns.values()}) > 1:
            raise ValueError("columns are given all by name or all by index")
        if self.format not in ("csv", "jsonl"):
            raise ValueError(f"unsupported format: {self.format}")

    @classmethod
    def from_json(cls, text: str) -> Source:
        return cls(**json.loads(text))

    def _rows(self, spark: SparkSession) -> tuple[DataFrame, Callable[[str | int], Column]]:
        """Raw rows, and how a column is found in them."""
        if self.format == "csv":
            rows = csv_of(spark, self.path, self.delimiter, self.encoding, self.has_header)
            return rows, lambda c: F.col(f"`{rows.columns[int(c)] if isinstance(c, int) or c.lstrip('-').isdigit() and c not in rows.columns else c}`")
        if self.archive == "zip":
            lines = archives.read_lines(spark, self.path, ".jsonl", self.members, self.encoding)
        else:
            lines = spark.read.text(self.path).select(F.col("value").alias("line"))
        # a line that is no object has no map, and is passed over
        rows = lines.select(F.from_json("line", "map<string, string>").alias("record")).where("record is not null")
        return rows, lambda c: F.col("record")[F.lit(c)]

    def read(self, spark: SparkSession) -> DataFrame:
        """raw_id, text, author, source, ts, lang, weight (and props where they are declared): blanks are null, a missing author is the id, a bad weight
        1. A source that is not there has no rows."""
        columns = "raw_id string, text string, author string, source string, ts string, lang string, weight double" + (", props map<string, string>" if self.props else "")
        if not (archives.exists(self.path) if self.archive else files(spark, self.path)):
            return spark.createDataFrame([], columns)
        rows, at = self._rows(spark)
        for c, allowed in self.keep_where.items():
            rows = rows.where(F.coalesce(at(c), F.lit("")).isin(*allowed))
        blank = lambda c: F.nullif(F.trim(c), F.lit(""))
        value = lambda k: blank(at(self.columns[k])) if k in self.columns else F.lit(None).cast("string")
        raw = F.coalesce(value("id"), F.md5(F.coalesce(value("text"), F.lit("")).cast("binary")))
        own = [F.struct(F.lit(k).alias("key"), blank(at(c)).alias("value")) for k, c in self.props.items()]
        props = [F.map_from_entries(F.filter(F.array(*own), lambda p: p["value"].isNotNull())).alias("props")] if own else []
        found = rows.select(
            raw.alias("raw_id"), value("text").alias("text"), F.coalesce(value("author"), raw).alias("author"), F.lit(self.name).alias("source"), F.coalesce(value("ts"), F.lit("")).alias("ts"),
            F.coalesce(value("lang"), F.lit(self.lang)).alias("lang"), F.coalesce(value("weight").try_cast("double"), F.lit(1.0)).alias("weight"), *props,
        ).where("text is not null")
        return found.where(F.col("lang").isin(*self.lang_keep)) if self.lang_keep else found


def discover(spark: SparkSession, folder: str) -> list[Source]:
    """The sources that the .json descriptors of a folder declare, in the order of their names."""
    return [Source.from_json(head(spark, f, 1 << 20).decode("utf-8")) for f in files(spark, folder) if f.endswith(".json")]


def read_all(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All sources as one bag of contributions."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.read(spark) for s in sources])


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions of the keys in `df`; the commit is atomic by Spark's committer."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def bake(df: DataFrame, path: str, order: list[str], partitions: int) -> None:
    """A serving table sorted by `order`, so that file statistics prune."""
    df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`current` with the rows of `changes` in place of those of equal keys."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)
