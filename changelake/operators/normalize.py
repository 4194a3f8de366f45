"""Raw change stream rows to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelake import schema


def normalize(raw: DataFrame, default_time: Column | None = None) -> DataFrame:
    """Rows (operationType, ns, documentKey, fullDocument, updateDescription, clusterTime, _id) as events.

    Operation names become lower case, and unknown ones stay as they are; a
    missing namespace or collection is empty; a negative new size is 0; a missing
    time is ``default_time`` (now, unless given).  A row without a token is no
    event and goes.
    """
    low = F.lower("operationType")
    truncated = F.transform(F.col("updateDescription.truncatedArrays"), lambda t: F.struct(t["field"].alias("field"), F.greatest(t["newSize"], F.lit(0)).cast("long").alias("newSize")))
    update = F.when(F.col("updateDescription").isNotNull(), F.struct(F.col("updateDescription.updatedFields").alias("updatedFields"), F.col("updateDescription.removedFields").alias("removedFields"), truncated.alias("truncatedArrays")))
    kept = [c for c in raw.columns if c not in ("operationType", "ns", "documentKey", "fullDocument", "updateDescription", "clusterTime", "_id")]
    return raw.where(F.col("_id").isNotNull()).select(
        *kept,
        F.when(low.isin(*schema.KNOWN), low).otherwise(F.coalesce("operationType", F.lit(""))).alias("operation"),
        F.coalesce("ns.database", F.lit("")).alias("database"),
        F.coalesce("ns.collection", F.lit("")).alias("collection"),
        F.col("documentKey").alias("document_key"),
        F.col("fullDocument").alias("full_document"),
        update.alias("update_description"),
        F.coalesce("clusterTime", default_time if default_time is not None else F.current_timestamp()).alias("cluster_time"),
        F.col("_id").alias("resume_token"),
    )
