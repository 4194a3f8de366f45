"""A Python data source that replays change events from JSON lines.

``spark.read.format("changelake_replay")`` and ``readStream`` take options

- ``path``: a folder of ``*.jsonl`` files (or of another ``suffix``), in the order of their names (any path
  of Hadoop's file systems is read by Spark's own text reader, see ``watch``;
  this source is for folders that executors can open);
- ``level`` (collection, database or deployment), ``database``, ``collections``;
- ``max_files``: how many files one micro-batch takes;
- ``resume_after``: a token; the stream starts at the line behind it, and a token
  that no line has is an error;
- ``broken``: what becomes of lines that are no event, ``skip`` or ``fail``.

An offset is a file's number and a line in it.  Parts of files are partitions, so
executors read them in parallel, and a replayed epoch reads the same lines.  A read that
fails for the file system's sake is a ``SourceError`` that allows a reconnect.
"""

from __future__ import annotations

import io
import itertools
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RAW = """operationType string, ns struct<database: string, collection: string>, documentKey string, fullDocument string,
updateDescription struct<updatedFields: string, removedFields: array<string>, truncatedArrays: array<struct<field: string, newSize: bigint>>>,
clusterTime timestamp, _id string, seq bigint"""
LEVELS = ("collection", "database", "deployment")
#: Bytes of a file's part that one task reads.
PART = 16 << 20


class SourceError(RuntimeError):
    """An error of a source.  Its text carries kind, code and labels, as it comes back from executors as text only."""

    def __init__(self, message: str, kind: str = "connection", code: int | None = None, labels: tuple[str, ...] = ()):
        super().__init__(f"[source error kind={kind} code={'' if code is None else code} labels={','.join(labels)}] {message}")


class Files(InputPartition):
    """The lines of a file from ``start`` on, of those that begin in the bytes from ``first`` on and before ``last`` where it is set."""

    def __init__(self, path: str, start: int = 0, first: int = 0, last: int | None = None):
        self.path, self.start, self.first, self.last = path, start, first, last


def parts(path: str, start: int = 0) -> list[Files]:
    """A file in parts of ``PART`` bytes; whole where lines are passed over, as their bytes aren't known."""
    try:
        size = os.path.getsize(path)
    except OSError:  # told by the task that reads it
        size = 0
    cuts = [] if start else range(PART, size, PART)
    return [Files(path, start, first, last) for first, last in zip([0, *cuts], [*cuts, None], strict=True)]


def _begin(file: io.BufferedReader, at: int) -> int:
    """Where the first line begins that does so at a byte or behind it."""
    if at:
        file.seek(at - 1)
        file.readline()
    return file.tell() if at else 0


def _document(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def parse(line: str) -> tuple | None:
    """A line as a raw row; null where it is broken."""
    from datetime import datetime

    try:
        e = json.loads(line)
        time = e.get("clusterTime")
        update = e.get("updateDescription")
        if update is not None:
            update = (_document(update.get("updatedFields")), update.get("removedFields"), [(t["field"], t["newSize"]) for t in update.get("truncatedArrays") or []] or None)
        ns = e.get("ns") or {}
        return (e.get("operationType"), (ns.get("database", ns.get("db")), ns.get("collection", ns.get("coll"))), _document(e.get("documentKey")), _document(e.get("fullDocument")), update, datetime.fromisoformat(time) if time else None, _document(e.get("_id")), e.get("seq"))
    except (ValueError, AttributeError, KeyError, TypeError):
        return None


def wanted(row: tuple, level: str, database: str | None, collections: set[str]) -> bool:
    db, coll = row[1]
    return level == "deployment" or (db == database and (level == "database" or coll in collections))


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"].removeprefix("file://"), options.get("suffix", ".jsonl")
        self.level = options.get("level", "database")
        if self.level not in LEVELS:
            raise ValueError(f"level must be one of {LEVELS}")
        self.database = options.get("database")
        self.collections = set(filter(None, options.get("collections", "").split(",")))
        if self.level == "collection" and not self.collections:
            raise ValueError("level collection needs collections")
        self.max_files = int(options.get("max_files", "1000"))
        self.resume = options.get("resume_after")
        self.broken = options.get("broken", "skip")
        if self.broken not in ("skip", "fail"):
            raise ValueError("broken must be skip or fail")

    def files(self) -> list[str]:
        return sorted(f"{self.path}/{f}" for f in os.listdir(self.path) if f.endswith(self.suffix))

    def rows(self, partition: Files) -> Iterator[tuple]:
        try:
            with open(partition.path, "rb") as file:
                first = _begin(file, partition.first)
                if partition.last is None:
                    file.seek(first)
                    lines = io.TextIOWrapper(file, encoding="utf-8")
                else:
                    size = _begin(file, partition.last) - first
                    file.seek(first)
                    lines = io.TextIOWrapper(io.BytesIO(file.read(size)), encoding="utf-8")
                for n, line in enumerate(itertools.islice(lines, partition.start, None), partition.start):
                    row = parse(line)
                    if row is None:
                        if self.broken == "fail":
                            raise SourceError(f"{partition.path}, line {self._lines(partition.path, first) + n + 1}: no event", "conversion")
                    elif wanted(row, self.level, self.database, self.collections):
                        yield row
        except OSError as e:
            raise SourceError(f"{partition.path}: {e}", labels=("NetworkError",)) from e

    @staticmethod
    def _lines(path: str, end: int) -> int:
        """The lines of a file before a byte."""
        with open(path, "rb") as file:
            return sum(1 for _ in io.TextIOWrapper(io.BytesIO(file.read(end)), encoding="utf-8"))


class ReplayBatch(_Reader, DataSourceReader):
    def partitions(self):
        return [p for f in self.files() for p in parts(f)]

    def read(self, partition):
        return self.rows(partition)


class ReplayStream(_Reader, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.reached: int | None = None  # files up to the last offset given out; unknown after a restart

    def initialOffset(self):
        at = self._behind(self.resume) if self.resume else {"file": 0, "line": 0}
        self.reached = at["file"]
        return at

    def _behind(self, token: str) -> dict:
        for i, f in enumerate(self.files()):
            with open(f, encoding="utf-8") as lines:
                for n, x in enumerate(lines):
                    if (row := parse(x)) and row[6] == token:
                        return {"file": i, "line": n + 1}
        raise SourceError(f"no event has the token {token}", "invalid_token", 286)

    def latestOffset(self):
        files = len(self.files())
        # Behind a checkpoint's offset, which Spark does not tell here, the first micro-batch takes all there is.
        self.reached = files if self.reached is None else min(files, self.reached + self.max_files)
        return {"file": self.reached, "line": 0}

    def partitions(self, start, end):
        self.reached = max(self.reached or 0, end["file"])
        files, first = self.files(), start["file"]
        return [p for i in range(first, min(end["file"], len(files))) for p in parts(files[i], start.get("line", 0) if i == first else 0)]

    def read(self, partition):
        return self.rows(partition)

    def commit(self, end):
        pass


class ReplaySource(DataSource):
    @classmethod
    def name(cls):
        return "changelake_replay"

    def schema(self):
        return RAW

    def reader(self, schema):
        return ReplayBatch(self.options)

    def streamReader(self, schema):
        return ReplayStream(self.options)


def at_level(events: DataFrame, level: str, database: str | None = None, collections: list[str] | None = None) -> DataFrame:
    """Events of a watch level: some collections, a database, or all; plain predicates that reach the scan."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    if level == "collection":
        if not collections:
            raise ValueError("level collection needs collections")
        events = events.where(F.col("collection").isin(*collections))
    return events if level == "deployment" or database is None else events.where(F.col("database") == database)


def describe_level(level: str, collections: list[str] | None = None) -> str:
    if level != "collection":
        return level
    n = len(collections or [])
    return "no collections" if not n else f"1 collection ({collections[0]})" if n == 1 else f"{n} collections"


def watch(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Raw rows streamed from JSON lines by Spark's text source: any file system, files as partitions."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return from_lines(lines)


def from_lines(lines: DataFrame) -> DataFrame:
    """Raw rows of a column ``value`` of JSON lines; documents stay text as they came."""
    update = "struct<updatedFields: string, removedFields: array<string>, truncatedArrays: array<struct<field: string, newSize: bigint>>>"
    shape = f"struct<operationType: string, ns: struct<database: string, collection: string>, documentKey: string, fullDocument: string, updateDescription: {update}, clusterTime: timestamp, _id: string, seq: bigint>"
    return lines.select(F.from_json("value", shape).alias("e")).select("e.*")
