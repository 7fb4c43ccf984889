"""Members of zip archives as rows of lines, one partition a member, read as streams; and errors of raw files."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines, and characters of lines, that one batch holds at most.
BATCH_LINES, BATCH_CHARS = 4096, 4 << 20
_COPY = 1 << 20


class LoaderError(ValueError):
    """A raw file that is not what its format says."""


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def exists(uri: str) -> bool:
    system, path = located(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


class _File(io.RawIOBase):
    """A seekable Arrow file as Python's own kind, which says OSError for a place outside the file."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self.file = system.open_input_file(path)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        data = self.file.read(len(room))
        room[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(uri: str) -> io.BufferedReader:
    return io.BufferedReader(_File(uri), _COPY)


def names(uri: str) -> list[str]:
    """The members of an archive."""
    try:
        with opened(uri) as f, zipfile.ZipFile(f) as z:
            return z.namelist()
    except zipfile.BadZipFile as e:
        raise LoaderError(f"broken zip archive: {uri} ({e})") from e


class _Member(InputPartition):
    def __init__(self, archive: str, member: str):
        super().__init__((archive, member))
        self.archive, self.member = archive, member


class ZipLines(DataSource):
    """Format `zip_lines`. Options: path; suffix of the members to read, or members as a JSON list (those that are absent are passed over); encoding. An archive
    that does not exist has no rows. Undecodable bytes become replacement characters."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "member string, line_no long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8")
        self.suffix, self.members = options.get("suffix", ""), json.loads(options.get("members", "[]"))

    def partitions(self) -> list[InputPartition]:
        there = names(self.path) if exists(self.path) else []
        wanted = [m for m in self.members if m in there] if self.members else [m for m in there if m.endswith(self.suffix)]
        return [_Member(self.path, m) for m in wanted] or [_Member(self.path, "")]

    def read(self, partition: _Member) -> Iterator[pa.RecordBatch]:
        if not partition.member:
            return
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as raw:
            held, size, first = [], 0, 0
            for line in io.TextIOWrapper(raw, encoding=self.encoding, errors="replace"):
                held.append(line.rstrip("\r\n"))
                size += len(line)
                if len(held) >= BATCH_LINES or size >= BATCH_CHARS:
                    yield _batch(partition.member, first, held)
                    first, held, size = first + len(held), [], 0
            if held:
                yield _batch(partition.member, first, held)


def _batch(member: str, first: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([member] * len(lines)), pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines)], names=["member", "line_no", "line"])


def read_lines(spark: SparkSession, uri: str, suffix: str = "", members: list[str] | None = None, encoding: str = "utf-8") -> DataFrame:
    """member, line_no (from 0), line of the members of an archive."""
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").option("path", uri).option("suffix", suffix).option("members", json.dumps(members or [])).option("encoding", encoding).load()


def single(uri: str, suffix: str) -> str:
    """The one member with this ending (in any case); an error names the members when there is none or more than one."""
    there = names(uri)
    found = [m for m in there if m.lower().endswith(suffix)]
    if len(found) != 1:
        raise LoaderError(f"zip archive without a single {suffix} member: {there} ({uri})")
    return found[0]


def unpacked(spark: SparkSession, uri: str, member: str, target: str) -> str:
    """The member as a file of its own at `target`, copied as a stream by one task."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_system, out_path = located(target)
            out_system.create_dir(out_path.rsplit("/", 1)[0], recursive=True)
            total = 0
            with opened(uri) as f, zipfile.ZipFile(f) as z, z.open(member) as raw, out_system.open_output_stream(out_path) as out:
                while piece := raw.read(_COPY):
                    out.write(piece)
                    total += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    spark.range(1).coalesce(1).mapInArrow(copy, "n long").collect()
    return target
