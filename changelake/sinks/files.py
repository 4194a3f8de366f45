"""File sinks: JSON lines, CSV, Parquet and Avro under partitioned paths.

Spark writes JSON, CSV and Parquet itself, so any file system it knows will do.
A batch's rows carry its epoch as the last partition column and replace only
their own partitions, so writing an epoch again leaves the same files: a replay
after a failure neither loses nor doubles events.

``objects`` encodes a flushed batch as whole objects (key and bytes) instead, for
formats and codecs Spark lacks (Avro, zstd lines) and for exact object names.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake import schema
from changelake.functions import events as E
from changelake.functions import keys as K
from changelake.sinks import avro
from changelake.sinks.base import ConfigurationError, Destination, Metadata, SerializationError

FORMATS = ("json", "csv", "parquet", "avro")
LAYOUTS = {"hive": ("collection", "year", "month", "day", "hour"), "date_hour": ("collection", "year", "month", "day", "hour"), "date": ("collection", "year", "month", "day"), "collection": ("collection",), "flat": ()}
#: Documents may hold line ends, quotes, commas and spaces at either end.
CSV = {"header": True, "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Rows of a file that can't be split, gzip or CSV over lines, as one task reads it whole; the rebalancing bounds its bytes.
WHOLE = 100_000
_PARTS = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}


def rfc3339(time: Column, utc: str = "+00:00") -> Column:
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(utc))


def partitioned(events: DataFrame, layout: str, time: Column) -> tuple[DataFrame, list[str]]:
    """Add a layout's partition columns as zero-padded text."""
    columns = list(LAYOUTS[layout])
    for c in columns:
        if c in _PARTS:
            events = events.withColumn(c, F.date_format(time, _PARTS[c]))
    return events, columns


def text_rows(events: DataFrame) -> DataFrame:
    """Flat columns as text formats spell them: display names, times with an offset, nulls empty."""
    return events.withColumn("operation", E.display_name()).withColumn("cluster_time", rfc3339(F.col("cluster_time"))).withColumn("document_key", F.coalesce("document_key", F.lit(""))).withColumn("full_document", F.coalesce("full_document", F.lit("")))


def gathered(rows: DataFrame, columns: list[str], spread: int = 8) -> DataFrame:
    """Rows of a layout's partitions brought together, so that each gets few files.

    A partition's rows go to ``spread`` lanes by a hash, so that one hot collection
    doesn't end in one task.  With adaptive execution the rebalance hint joins small
    lanes and splits a large one by its bytes, which it can't within one task's rows.
    """
    by = [c for c in columns if c != "epoch"]  # the same for all rows
    if not by:
        return rows
    laned = rows.withColumn("__lane", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in by]), F.lit(spread)))
    adaptive = rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    return (laned.hint("rebalance", *by, "__lane") if adaptive else laned.repartition(*by, "__lane")).drop("__lane")


def write(events: DataFrame, path: str, fmt: str = "json", compression: str = "none", layout: str = "hive", time: Column | None = None, epoch: int | None = None, include_update: bool = False, limit: int | None = None) -> None:
    """Write a batch below ``path``, in files of at most ``limit`` rows (``WHOLE`` by default where a file can't be split); with an epoch, replacing only that epoch's files."""
    if fmt not in ("json", "csv", "parquet"):
        raise ConfigurationError(f"Spark cannot write {fmt}; use objects()")
    if compression == "zstd" and fmt != "parquet":
        raise ConfigurationError("zstd lines are written by objects(); Parquet takes zstd inside")
    rows, columns = partitioned(events, layout, time if time is not None else F.current_timestamp())
    if epoch is not None:
        rows, columns = rows.withColumn("epoch", F.lit(epoch)), [*columns, "epoch"]
    if fmt == "json":
        rows = rows.select(*columns, E.json_line().alias("value"))
    else:
        rows = text_rows(rows) if fmt == "csv" else rows
        flat = [c for c in schema.FLAT7 if c != "collection" or "collection" not in columns]
        update = [F.to_json("update_description").alias("update_description")] if include_update else []
        rows = rows.select(*columns, *flat, *update)
    codec = {"none": "uncompressed" if fmt == "parquet" else "none"}.get(compression, compression)
    out = gathered(rows, columns).write.option("compression", codec)
    if limit is None and (fmt == "csv" or (fmt == "json" and compression == "gzip")):
        limit = WHOLE
    if limit:
        out = out.option("maxRecordsPerFile", limit)
    out = out.mode("overwrite" if epoch is not None else "append").option("partitionOverwriteMode", "dynamic")
    out = out.partitionBy(*columns) if columns else out
    if fmt == "json":
        out.text(path)
    elif fmt == "csv":
        out.options(**CSV, emptyValue="").csv(path)
    else:
        out.parquet(path)


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Flat events of a written tree, operations and times as events have them."""
    if fmt == "parquet":
        return spark.read.option("partitionOverwriteMode", "dynamic").parquet(path)
    if fmt == "json":
        return from_lines(spark.read.text(path))
    if fmt == "csv":
        return from_text(spark.read.options(**CSV, multiLine=True).csv(path))  # columns by the header's names, all text
    return from_text(read_avro(spark, path))


def from_lines(lines: DataFrame) -> DataFrame:
    """Flat events of a column ``value`` of JSON lines."""
    shape = "struct<operationType: string, ns: struct<database: string, collection: string>, documentKey: string, fullDocument: string, clusterTime: timestamp, _id: string>"
    e = lines.select(F.from_json("value", shape).alias("e")).select("e.*")
    return e.select(F.col("operationType").alias("operation"), "ns.database", "ns.collection", F.col("clusterTime").alias("cluster_time"), F.col("documentKey").alias("document_key"), F.col("fullDocument").alias("full_document"), F.col("_id").alias("resume_token"))


def from_text(rows: DataFrame) -> DataFrame:
    """Flat text rows as events: the reverse of ``text_rows``."""
    shown = F.col("operation")
    operation = F.coalesce(F.nullif(F.regexp_extract(shown, r'^Unknown\("(.*)"\)$', 1), F.lit("")), F.lower(shown))
    null = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(operation.alias("operation"), F.coalesce("database", F.lit("")).alias("database"), F.col("collection").cast("string").alias("collection"), F.to_timestamp("cluster_time").alias("cluster_time"), null("document_key").alias("document_key"), null("full_document").alias("full_document"), "resume_token")


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """Flat text rows of Avro objects; whole files are decoded in the executors."""

    return decoded_avro(_whole(spark, path, ".avro"))


def decoded_avro(contents: DataFrame) -> DataFrame:
    """Flat text rows of a column ``content`` of whole Avro files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(avro.decode(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * len(avro.COLUMNS))], avro.COLUMNS)

    return contents.select("content").mapInArrow(run, ", ".join(f"{c} string" for c in avro.COLUMNS))


def _whole(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("content")


def read_objects(spark: SparkSession, path: str, fmt: str, compression: str = "none") -> DataFrame:
    """Flat events of a tree of objects, whatever their names."""
    if fmt == "avro":
        return from_text(read_avro(spark, path))
    if compression == "zstd" and fmt != "parquet":

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content"):
                    yield pa.RecordBatch.from_arrays([pa.array(_decompress(content.as_py(), "zstd").decode().splitlines())], ["value"])

        if fmt != "json":
            raise ConfigurationError("zstd CSV is not read here")
        return from_lines(_whole(spark, path, ".zst").mapInArrow(run, "value string"))
    reader = spark.read.option("recursiveFileLookup", True)
    if fmt == "json":
        return from_lines(reader.text(path))
    return from_text(reader.options(**CSV, multiLine=True).csv(path)) if fmt == "csv" else reader.parquet(path)


def _compress(data: bytes, compression: str) -> bytes:
    if compression == "gzip":
        return gzip.compress(data, mtime=0)
    if compression == "zstd":
        try:
            import zstandard
        except ImportError as e:
            raise SerializationError("zstd needs the zstandard package") from e
        return zstandard.ZstdCompressor(level=3).compress(data)
    return data


def _decompress(data: bytes, compression: str) -> bytes:
    if compression == "gzip":
        return gzip.decompress(data)
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def encoded(events: DataFrame, fmt: str) -> list[Column]:
    """The columns from which ``build`` makes an object: a whole row for lines and Avro, the flat ones for tables."""
    if fmt == "json":
        return [F.concat(E.json_line(), F.lit("\n")).cast("binary").alias("row")]
    if fmt == "avro":
        return [avro.row().alias("row")]
    if fmt == "csv":
        return [F.col(c).cast("string").alias(c) for c in schema.FLAT7]
    return [F.col(c).alias(c) for c in schema.FLAT7]


def build(rows: pa.Table, fmt: str, compression: str) -> bytes:
    """One object of the rows that ``encoded`` gave; codecs go around lines and CSV, and inside Parquet and Avro."""
    if fmt == "json":
        return _compress(b"".join(rows["row"].to_pylist()), compression)
    if fmt == "avro":
        if compression == "zstd":
            raise ConfigurationError("Avro objects take no codec but deflate")
        return avro.assemble(rows["row"].to_pylist(), "deflate" if compression == "gzip" else "null")
    out = io.BytesIO()
    if fmt == "csv":
        import csv

        text = io.StringIO()
        lines = csv.writer(text, lineterminator="\n")
        lines.writerow(rows.column_names)
        lines.writerows(zip(*(rows[c].to_pylist() for c in rows.column_names), strict=True))
        return _compress(text.getvalue().encode(), compression)
    import pyarrow.parquet as pq

    pq.write_table(rows, out, compression=compression)
    return out.getvalue()


def objects(batches: DataFrame, keys: list[str], key: Column, fmt: str = "avro", compression: str = "none") -> DataFrame:
    """(object_key, n, content): one object for each flushed batch.

    ``keys`` identify a batch, which batching bounds; ``key`` names its object
    and must depend on ``keys`` alone.
    """
    if fmt not in ("json", "avro"):
        raise ConfigurationError(f"{fmt} objects are written by Spark")
    texts = text_rows(batches) if fmt == "avro" else batches
    lines = texts.select(*keys, key.alias("object_key"), *encoded(texts, fmt))

    def run(table: pa.Table) -> pa.Table:
        content = build(table, fmt, compression)
        return pa.table({"object_key": table["object_key"].slice(0, 1), "n": pa.array([len(table)], pa.int64()), "content": pa.array([content], pa.binary())})

    return lines.groupBy(*keys).applyInArrow(run, "object_key string, n long, content binary")


def put(made: DataFrame, root: str, options: dict | None = None) -> int:
    """Write objects below ``root`` from the executors; returns how many.

    ``root`` is a path or a URI that pyarrow's file systems know (file, s3, gs, hdfs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("object_key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                store(root, name, content, options)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return made.select("object_key", "content").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def filesystem(root: str, options: dict | None = None) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; ``options`` are those of an S3 client."""
    scheme, found, rest = root.partition("://")
    if not found:
        return pa_fs.LocalFileSystem(), root
    if scheme in ("s3", "s3a", "s3n"):
        options = dict(options or {})
        if tries := options.pop("max_attempts", None):
            options["retry_strategy"] = pa_fs.AwsStandardS3RetryStrategy(max_attempts=tries)
        return pa_fs.S3FileSystem(**options), rest
    return pa_fs.FileSystem.from_uri(root)


def store(root: str, name: str, content: bytes, options: dict | None = None) -> None:
    """Write one object whole: a local file appears by a rename, an object of a store when its upload ends."""
    fs, base = filesystem(root, options)
    path = f"{base.rstrip('/')}/{name}"
    renames = not isinstance(fs, pa_fs.S3FileSystem)
    if renames:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part" if renames else path
    with fs.open_output_stream(part, compression=None) as out:
        out.write(content)
    if renames:
        fs.move(part, path)


class FileDestination(Destination):
    """A destination below a path; batches are written as they come, epochs replace themselves."""

    def __init__(self, path: str, fmt: str = "json", compression: str = "none", layout: str = "date_hour", time_column: str | None = None):
        if fmt not in ("json", "csv", "parquet") or compression not in K.COMPRESSED or layout not in LAYOUTS:
            raise ConfigurationError(f"unsupported: {fmt}, {compression}, {layout}")
        super().__init__()
        self.path, self.fmt, self.compression, self.layout, self.time_column = path, fmt, compression, layout, time_column

    def _write(self, batch: DataFrame, epoch: int) -> None:
        time = F.col(self.time_column) if self.time_column else None
        write(batch, self.path, self.fmt, self.compression, self.layout, time, epoch, limit=self.limit)

    def metadata(self) -> Metadata:
        return Metadata("files", "files", False, None, True, {"path": self.path, "format": self.fmt})
