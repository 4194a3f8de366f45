"""Object keys, resume token keys and lock keys."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# How each strategy lays out object keys.
PATTERNS = {
    "hive": "{prefix}/collection={name}/year={YYYY}/month={MM}/day={DD}/hour={HH}/{timestamp}.{ext}",
    "date_hour": "{prefix}/{collection}/{YYYY}/{MM}/{DD}/{HH}/{timestamp}.{ext}",
    "date": "{prefix}/{collection}/{YYYY}/{MM}/{DD}/{timestamp}.{ext}",
    "collection": "{prefix}/{collection}/{timestamp}.{ext}",
    "flat": "{prefix}/{collection}_{timestamp}.{ext}",
}
_TIMES = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH"}
EXTENSIONS = {"json": "jsonl", "csv": "csv", "parquet": "parquet", "avro": "avro"}
MIME = {"json": "application/x-ndjson", "csv": "text/csv", "parquet": "application/vnd.apache.parquet", "avro": "application/avro"}
COMPRESSED = {"none": "", "gzip": ".gz", "zstd": ".zst"}


def object_key(strategy: str, prefix: str | None, collection: Column | str, time: Column | str, extension: str, compression: str = "") -> Column:
    """The key of an object flushed at ``time``, by one of PATTERNS.  No prefix and an empty one are the same."""
    collection = F.col(collection) if isinstance(collection, str) else collection
    time = F.col(time) if isinstance(time, str) else time
    pieces: list[Column] = []
    rest = PATTERNS[strategy].removeprefix("{prefix}/")
    while rest:
        fixed, _, rest = rest.partition("{")
        if fixed:
            pieces.append(F.lit(fixed))
        field, _, rest = rest.partition("}")
        if field in _TIMES:
            pieces.append(F.date_format(time, _TIMES[field]))
        elif field in ("name", "collection"):
            pieces.append(collection)
        elif field == "timestamp":
            pieces.append(F.unix_millis(time).cast("string"))
        elif field == "ext":
            pieces.append(F.lit(extension + compression))
    return F.concat(*([F.lit(f"{prefix}/")] if prefix else []), *pieces)


def object_name(strategy: str, prefix: str | None, collection: str, time: datetime, extension: str, compression: str = "", part: str = "") -> str:
    """As ``object_key``, of one object; ``part`` follows the timestamp."""
    ms = (time - datetime(1970, 1, 1, tzinfo=time.tzinfo)) // timedelta(milliseconds=1)
    pattern = PATTERNS[strategy] if prefix else PATTERNS[strategy].removeprefix("{prefix}/")
    fields = {k: f"{time:{v}}" for k, v in {"YYYY": "%Y", "MM": "%m", "DD": "%d", "HH": "%H"}.items()}
    return pattern.format(prefix=prefix, name=collection, collection=collection, timestamp=f"{ms}{part}", ext=extension + compression, **fields)


def resume_token_key(level: Column, database: Column, collection: Column) -> Column:
    """One key for each scope, used for reading and writing alike."""
    named = F.when(collection.isNull(), F.concat(F.lit("resume_token:"), database)).otherwise(F.concat(F.lit("resume_token:"), database, F.lit(":"), collection))
    return F.when(level == "collection", named).when(level == "database", F.concat(F.lit("resume_token:database:"), database)).otherwise(F.lit("resume_token:deployment"))


def lock_key(level: Column, database: Column, collection: Column, prefix: str = "changelake:lock") -> Column:
    scope = F.when(level == "collection", collection).when(level == "database", F.lit("__database__")).otherwise(F.lit("__deployment__"))
    return F.concat_ws(":", F.lit(prefix), F.coalesce(database, F.lit("")), scope)
