"""A deterministic change log from the ``events`` table, in Spark and as oracle SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = [
    "event_id", "user_id", "ts", "props",
    "CASE user_id % 3 WHEN 0 THEN 'users' WHEN 1 THEN 'orders' ELSE 'products' END AS collection",
    """CASE WHEN event_id % 400 = 399 THEN 'invalidate' WHEN event_id % 400 = 199 THEN 'drop'
       WHEN event_id % 400 = 299 THEN 'rename' WHEN event_id % 400 = 99 THEN 'dropdatabase'
       WHEN event_id % 400 = 49 THEN 'futureOperation'
       WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'view' THEN 'replace'
       WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS operation""",
]


def _log(time: str, text: str) -> list[str]:
    return [
        "event_id", "operation", "'testdb' AS database", "collection", f"{time} AS cluster_time",
        f"""CASE WHEN operation IN ('insert','update','replace','delete') THEN concat('{{"_id":', CAST(user_id AS {text}), '}}') END AS document_key""",
        "CASE WHEN operation IN ('insert','update','replace') THEN props END AS full_document",
        f"""concat('{{"_data":"token_', collection, '_', CAST(event_id AS {text}), '"}}') AS resume_token""",
    ]


#: The log as a common table expression for the oracle.
CHG = f"WITH chg AS (SELECT {', '.join(_log('ts', 'VARCHAR'))} FROM (SELECT {', '.join(_BASE)} FROM events)) "


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id (the sequence), the flat event columns, and a typed update_description."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    log = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_BASE).selectExpr(*_log("CAST(ts AS TIMESTAMP)", "STRING"))
    removed = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("legacy"))).otherwise(F.array().cast("array<string>"))
    truncated = F.lit(None).cast("array<struct<field: string, newSize: bigint>>")
    update = F.when(F.col("operation") == "update", F.struct(F.col("full_document").alias("updatedFields"), removed.alias("removedFields"), truncated.alias("truncatedArrays")))
    return log.withColumn("update_description", update)


def workspace(spark: SparkSession) -> str:
    """A new folder for a query's own files: in the shared checkpoint folder, or on one machine a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/changelake-work"
    return f"{root.rstrip('/')}/plans/{uuid.uuid4().hex}"
