"""A Spark data source for folders of raw events: JSON lines, in batch and as a stream, in any file system that pyarrow opens.

    register_raw(spark)
    spark.read.format("tidemark_raw").options(**RAW["repository"]).load(folder).where("at >= …")

Rows are (at, kind, line, file): the event's time in UTC and its kind, taken from fields that options name, and the whole line for an importer. Batch reads are cut into
pieces of files by bytes. Comparisons of `at`, `kind` and `file` are pushed into the reader: files and lines that they rule out never leave the task that
reads them. As a stream it follows logs that grow and are rotated: files in the order of their names, of which only the last one is appended to; the offset is a
name and a number of bytes, whatever the folder holds. A line that is not ended yet waits for its end.

Lines that are no JSON objects have neither time nor kind; empty lines are passed over; files whose names begin with a dot or underscore are not read. Zipped files (.gz) are read in one
piece, in batch only. Options: path, time and kind (names of fields), piece (bytes).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

#: Fields of the services' events.
RAW = {"repository": {"time": "created_at", "kind": "type"}, "activity": {"time": "date", "kind": "kind"}}
SHAPE = pa.schema([("at", pa.timestamp("us")), ("kind", pa.string()), ("line", pa.string()), ("file", pa.string())])
#: Bytes of a piece, and lines handed on at once.
PIECE, LINES = 32 << 20, 4096

TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v),
}


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin in [start, end); end -1: the whole file, which may be zipped."""

    file: str
    start: int
    end: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def listed(path: str) -> list[pafs.FileInfo]:
    """The files of a folder, or a file itself, in the order of their names."""
    files, base = opened(path)
    info = files.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [info]
    found = files.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[0] in "._" for x in p.removeprefix(base).split("/") if x)
    return sorted((x for x in found if x.type == pafs.FileType.File and not hidden(x.path)), key=lambda x: x.path)


def lines_of(files: pafs.FileSystem, piece: Piece, block: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a piece, without their ends; a line belongs to the piece in which it begins."""
    if piece.end < 0:
        with files.open_input_stream(piece.file, compression="detect") as f:
            rest = b""
            while more := f.read(block):
                *whole, rest = (rest + more).split(b"\n")
                yield from whole
            yield rest
        return
    with files.open_input_file(piece.file) as f:
        at = max(piece.start - 1, 0)  # the byte before tells whether a line begins at start
        f.seek(at)
        rest, skip = b"", piece.start > 0
        while at < piece.end:
            more = f.read(block)
            if not more:
                break
            *whole, rest = (rest + more).split(b"\n")
            for x in whole:
                if at >= piece.end:
                    return
                if not skip:
                    yield x
                skip, at = False, at + len(x) + 1
        if at < piece.end and not skip and rest:
            yield rest


def moment(text: object) -> datetime | None:
    """A time as UTC without zone; times without a zone are UTC."""
    try:
        found = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found


class _Reading:
    """What batch and stream have in common."""

    def __init__(self, options: dict):
        self.path = options.get("path") or ""
        if not self.path:
            raise ValueError("the source needs a path")
        self.time, self.kind, self.size = options.get("time", "created_at"), options.get("kind", "type"), int(options.get("piece", PIECE))
        self.tests: list[tuple[str, type, object]] = []

    def allows(self, column: str, value: object) -> bool:
        return all(value is not None and TESTS[kind](value, wanted) for c, kind, wanted in self.tests if c == column)

    def pieces(self, file: str, start: int, end: int) -> list[Piece]:
        if not self.allows("file", file):
            return []
        if file.endswith(".gz"):
            return [Piece(file, 0, -1)]
        return [Piece(file, at, min(at + self.size, end)) for at in range(start, end, self.size)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        held: list[tuple] = []
        for raw in lines_of(files, piece):
            line = raw.decode("utf-8", "replace").rstrip("\r")
            if not line.strip():
                continue
            try:
                event = json.loads(line)
            except ValueError:
                event = None
            event = event if isinstance(event, dict) else {}
            at, kind = moment(event.get(self.time)), event.get(self.kind)
            kind = kind if isinstance(kind, str) else None
            if self.allows("at", at) and self.allows("kind", kind):
                held.append((at, kind, line, piece.file))
            if len(held) == LINES:
                yield self.batch(held)
                held = []
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), SHAPE.types, strict=True)], schema=SHAPE)


class RawReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keeps what it can test on a line or a file name; the rest is left to Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            fits = isinstance(value, datetime) and value.tzinfo is None if column == ("at",) else isinstance(value, (str, tuple, list))
            known = type(f) in TESTS and column in (("at",), ("kind",), ("file",)) and not (column == ("at",) and type(f) in (In, StringStartsWith))
            if known and fits:
                self.tests.append((column[0], type(f), value))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        return [p for x in listed(self.path) for p in self.pieces(x.path, 0, x.size)] or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.file:
            yield from _Reading.read(self, piece)


class RawStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "bytes": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last file and its bytes up to the last end of a line."""
        found = [x for x in listed(self.path) if not x.path.endswith(".gz")]
        if not found:
            return self.initialOffset()
        files, last = opened(self.path)[0], found[-1]
        end = last.size
        with files.open_input_file(last.path) as f:
            while end > 0:
                start = max(0, end - (1 << 16))
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                end = start + at + 1 if at >= 0 else start
                if at >= 0:
                    break
        return {"file": last.path, "bytes": end}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for x in listed(self.path):
            if x.path.endswith(".gz") or x.path < start["file"] or x.path > end["file"]:
                continue
            low = start["bytes"] if x.path == start["file"] else 0
            out += self.pieces(x.path, low, end["bytes"] if x.path == end["file"] else x.size)
        return out or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.file:
            yield from _Reading.read(self, piece)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offsets."""


class RawEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_raw"

    def schema(self) -> str:
        return "at timestamp_ntz, kind string, line string, file string"

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def streamReader(self, schema) -> RawStream:  # noqa: N802
        return RawStream(self.options)


def register_raw(spark: SparkSession) -> None:
    """Make the format tidemark_raw known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawEvents)
