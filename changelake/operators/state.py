"""State from a change log: deduplication, latest versions, lookups, cut-offs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake import schema

#: Groups in which events without a document key pass by.
LANES = 256


def dedup_by_key(events: DataFrame, key: str = "document_key", order: str = "event_id") -> DataFrame:
    """The first event of each key; all events without a key.

    An aggregate, not a window: each task sends at most one row a key.
    """
    rest = [c for c in events.columns if c not in (order, key)]
    firsts = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("first")).select(key, "first.*")
    return firsts.select(*events.columns).unionAll(events.where(F.col(key).isNull()))


def latest_by_key(events: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c not in (order, *keys)]
    return events.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("last")).select(*keys, "last.*").select(*events.columns)


def update_lookup(events: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """Fill full_document of updates with the last version known at that point."""
    seen = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce("full_document", F.last("full_document", ignorenulls=True).over(seen))
    return events.withColumn("full_document", F.when(F.col("operation") == "update", filled).otherwise(F.col("full_document")))


def pre_image(events: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """Add full_document_before_change: the version before each event."""
    return events.withColumn("full_document_before_change", F.lag("full_document").over(Window.partitionBy(*keys).orderBy(order)))


def images(events: DataFrame, lookup: bool = True, before: bool = False, order: str = "seq", keys: tuple[str, ...] = ("database", "collection", "document_key")) -> DataFrame:
    """A stream of events with the versions of documents that the stream itself has seen.

    ``lookup`` fills updates that have no document with its last version;
    ``before`` adds full_document_before_change.  The last version of each document
    is the query's state, in Spark's state store; a delete clears it.  Events of a
    document in one micro-batch meet in one task, so the source's admission limit
    bounds them.  Events without a document key pass as they are, many in a group.
    """
    shape = T.StructType([f for f in events.schema.fields if f.name != "update_description"])
    if before:
        shape = T.StructType([*shape.fields, T.StructField("full_document_before_change", T.StringType())])
    wire = T.StructType([*shape.fields, T.StructField("update_description", T.StringType())])
    by = {f"__{c}": F.coalesce(c, F.lit("")) for c in keys} | {"__alone": F.when(F.col("document_key").isNull(), F.pmod(F.xxhash64("resume_token"), F.lit(LANES)).cast("string")).otherwise("")}

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if key[-1]:
            for rows in frames:
                yield (rows.assign(full_document_before_change=None) if before else rows)[wire.names]
            return
        rows = pd.concat(list(frames))
        if not rows[order].is_monotonic_increasing:
            rows = rows.sort_values(order, kind="stable")
        last = state.get[0] if state.exists else None
        filled, earlier = [], []
        for operation, document in zip(rows["operation"], rows["full_document"], strict=True):
            document = None if document is None or pd.isna(document) else document
            earlier.append(last)
            if operation == "delete":
                last = None
            elif document is not None:
                last = document
            filled.append(last if lookup and operation == "update" and document is None else document)
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
        rows = rows.assign(full_document=filled, **({"full_document_before_change": earlier} if before else {}))
        yield rows[wire.names]

    flat = events.withColumn("update_description", F.to_json("update_description")).withColumns(by)
    out = flat.groupBy(*by).applyInPandasWithState(run, wire, "last string", "append", "NoTimeout")
    return out.withColumn("update_description", F.from_json("update_description", schema.UPDATE))


def token_sequence(token: Column) -> Column:
    """The sequence number within a resume token."""
    return F.regexp_extract(token, r'_([0-9]+)"', 1).try_cast("long")


def resume_after(events: DataFrame, token: str) -> DataFrame:
    """Events after the one whose token this is."""
    return events.where(token_sequence(F.col("resume_token")) > token_sequence(F.lit(token)))


def until_invalidate(events: DataFrame, order: str = "event_id", collection: str = "collection") -> DataFrame:
    """Events of each collection before its first invalidate."""
    stops = events.where(F.col("operation") == "invalidate").groupBy(collection).agg(F.min(order).alias("__stop"))
    return events.join(stops, collection, "left").where(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).select(*events.columns)


def latest_tokens(events: DataFrame, key: Column, order: str = "event_id") -> DataFrame:
    """(token_key, resume_token): the last token of each key."""
    return events.groupBy(key.alias("token_key")).agg(F.max_by("resume_token", order).alias("resume_token"))
