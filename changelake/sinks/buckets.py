"""An object store destination: whole objects under the names of a key strategy.

Each epoch's events are dealt into batches of at most ``limit`` events of one
collection; executors encode a batch as one object and upload it themselves, so
nothing passes the driver but a count.  An object's name follows its strategy's
pattern; epoch, lane and chunk stand behind the timestamp, which keeps names of
different batches apart and gives an epoch that is written again the same names.
The timestamp is the newest event's, not the clock's, for the same reason.
"""

from __future__ import annotations

from datetime import UTC

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.functions import keys as K
from changelake.operators.batching import capped
from changelake.sinks import files
from changelake.sinks.base import BucketConfig, ConfigurationError, Destination, Metadata

#: Events of an object where neither pipeline nor caller says.
LIMIT = 10_000


class ObjectDestination(Destination):
    """Objects below ``root``: a folder all executors share, or a URI of an object store."""

    def __init__(self, root: str, fmt: str = "json", compression: str = "none", strategy: str = "date_hour", prefix: str | None = None, time_column: str = "cluster_time", limit: int | None = None, options: dict | None = None):
        if fmt not in files.FORMATS or compression not in K.COMPRESSED or strategy not in K.PATTERNS:
            raise ConfigurationError(f"unsupported: {fmt}, {compression}, {strategy}")
        if fmt == "avro" and compression == "zstd":
            raise ConfigurationError("Avro objects take no codec but deflate")
        super().__init__()
        self.root, self.fmt, self.compression, self.strategy, self.prefix, self.time_column, self.limit, self.options = root, fmt, compression, strategy, prefix, time_column, limit, options
        self.objects_written = 0

    @classmethod
    def of(cls, config: BucketConfig, **options) -> ObjectDestination:
        """The destination of a bucket's settings."""
        return cls(f"s3://{config.bucket}", config.format, config.compression, config.key_strategy, config.prefix, options=config.client(), **options)

    def suffix(self) -> str:
        """The extension; codecs inside Parquet and Avro don't show."""
        return K.EXTENSIONS[self.fmt] + (K.COMPRESSED[self.compression] if self.fmt in ("json", "csv") else "")

    def _write(self, batch: DataFrame, epoch: int) -> None:
        fmt, compression, strategy, prefix, root, options, suffix = self.fmt, self.compression, self.strategy, self.prefix, self.root, self.options, self.suffix()
        dealt = capped(batch, self.limit or LIMIT, batch.count())
        keys = ["__collection", "lane", "chunk"]
        lines = dealt.withColumns({"__collection": F.col("collection"), "__time": F.col(self.time_column).cast("timestamp")})
        lines = files.text_rows(lines) if fmt in ("csv", "avro") else lines
        lines = lines.select(*keys, "__time", F.col("resume_token").alias("__order"), *files.encoded(lines, fmt))
        width = len(keys) + 2

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("__time", "ascending"), ("__order", "ascending")])
            newest = pc.max(table["__time"]).as_py().astimezone(UTC)
            collection, lane, chunk = (table[k][0].as_py() for k in keys)
            name = K.object_name(strategy, prefix, collection, newest, suffix, part=f"-{epoch}-{lane}-{chunk}")
            files.store(root, name, files.build(table.select(range(width, table.num_columns)), fmt, compression), options)
            return pa.table({"n": pa.array([len(table)], pa.int64())})

        # One row an object.
        self.objects_written += lines.groupBy(*keys).applyInArrow(run, "n long").count()

    def metadata(self) -> Metadata:
        return Metadata("objects", "s3" if self.root.startswith("s3") else "files", False, self.limit, True, {"root": self.root, "format": self.fmt, "strategy": self.strategy})
