"""The change event: schemas, operation names and metric names."""

from __future__ import annotations

from pyspark.sql import types as T

# Operation names of change streams, lower case.
MODIFICATIONS = ("insert", "update", "replace")
REMOVALS = ("delete", "drop", "dropdatabase")
DDL = ("drop", "dropdatabase", "rename")
KNOWN = ("insert", "update", "delete", "replace", "invalidate", "drop", "dropdatabase", "rename")
#: Names as text formats spell them.
DISPLAY = {"insert": "Insert", "update": "Update", "delete": "Delete", "replace": "Replace", "invalidate": "Invalidate", "drop": "Drop", "dropdatabase": "DropDatabase", "rename": "Rename"}

TRUNCATED = T.StructType([T.StructField("field", T.StringType()), T.StructField("newSize", T.LongType())])
UPDATE = T.StructType([T.StructField("updatedFields", T.StringType()), T.StructField("removedFields", T.ArrayType(T.StringType())), T.StructField("truncatedArrays", T.ArrayType(TRUNCATED))])
#: Documents are JSON text, which keeps key order and the spelling of numbers.
EVENT = T.StructType(
    [
        T.StructField("operation", T.StringType(), False),
        T.StructField("database", T.StringType(), False),
        T.StructField("collection", T.StringType(), False),
        T.StructField("document_key", T.StringType()),
        T.StructField("full_document", T.StringType()),
        T.StructField("update_description", UPDATE),
        T.StructField("cluster_time", T.TimestampType(), False),
        T.StructField("resume_token", T.StringType(), False),
    ]
)
FLAT7 = ("operation", "database", "collection", "cluster_time", "document_key", "full_document", "resume_token")

# Names of exported metrics.
COUNTERS = ("events_processed_total", "events_failed_total", "retries_total", "batches_written_total", "destination_write_errors_total", "lock_acquisitions_total", "lock_acquisition_failures_total", "lock_refreshes_total", "locks_lost_total", "locks_released_total")
GAUGES = ("active_collections", "pipeline_status", "batch_queue_size", "locks_held")
HISTOGRAMS = ("batch_size", "batch_duration_seconds", "destination_write_duration_seconds", "destination_write_bytes", "change_stream_lag_seconds")
