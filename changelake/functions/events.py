"""Predicates and projections of change events: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelake import schema


def _op(op: Column | str) -> Column:
    return F.col(op) if isinstance(op, str) else op


def is_data_modification(op: Column | str = "operation") -> Column:
    return _op(op).isin(*schema.MODIFICATIONS)


def is_data_removal(op: Column | str = "operation") -> Column:
    return _op(op).isin(*schema.REMOVALS)


def is_ddl(op: Column | str = "operation") -> Column:
    return _op(op).isin(*schema.DDL)


def is_unknown(op: Column | str = "operation") -> Column:
    return ~_op(op).isin(*schema.KNOWN)


def is_operation(name: str, op: Column | str = "operation") -> Column:
    return _op(op) == name


def display_name(op: Column | str = "operation") -> Column:
    """An operation as CSV and Avro spell it."""
    out = F.concat(F.lit('Unknown("'), _op(op), F.lit('")'))
    for name, shown in schema.DISPLAY.items():
        out = F.when(_op(op) == name, shown).otherwise(out)
    return out


def has_full_document(doc: str = "full_document") -> Column:
    return F.col(doc).isNotNull()


def has_update_description(delta: str = "update_description") -> Column:
    return F.col(delta).isNotNull()


def full_namespace(database: str = "database", collection: str = "collection") -> Column:
    return F.concat_ws(".", F.col(database), F.col(collection))


def document_id(key: str = "document_key") -> Column:
    """The key's ``_id`` as text; null if there is none."""
    return F.get_json_object(F.col(key), "$._id")


def _keys(doc: Column) -> Column:
    return F.coalesce(F.size(F.json_object_keys(doc)), F.lit(0))


def estimated_size(base_size: int = 200, per_field: int = 50, update: str | None = "update_description") -> Column:
    """A fixed share, a share for each top-level field, and the removed fields' names."""
    fields = F.when(F.col("document_key").isNull(), 0).otherwise(_keys(F.col("document_key"))) + F.when(F.col("full_document").isNull(), 0).otherwise(_keys(F.col("full_document")))
    removed = F.lit(0)
    if update:
        delta = F.col(update)
        fields = fields + F.when(delta["updatedFields"].isNull(), 0).otherwise(_keys(delta["updatedFields"]))
        removed = F.coalesce(F.aggregate(delta["removedFields"], F.lit(0), lambda s, x: s + F.length(x)), F.lit(0))
    return (F.lit(base_size) + fields * per_field + removed).cast("long")


def update_fields(update: str = "update_description") -> Column:
    """Names of the fields that an update set."""
    return F.json_object_keys(F.col(update)["updatedFields"])


def flat7(include_update: bool = False) -> list[Column]:
    """The flat projection of the tabular formats; the update is dropped unless asked for."""
    out = [F.col(c) for c in schema.FLAT7]
    return [*out, F.to_json("update_description").alias("update_description")] if include_update else out


def one_line(document: Column) -> Column:
    """A JSON text without line ends: they can only stand between its members, where a space will do."""
    return F.translate(document, "\r\n", "  ")


def json_line() -> Column:
    """An event as one JSON line: absent members left out, documents spliced in, on one line."""
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    delta = F.col("update_description")
    truncated = F.when(delta["truncatedArrays"].isNotNull(), F.concat(F.lit(',"truncatedArrays":'), F.to_json(delta["truncatedArrays"]))).otherwise("")
    update = F.when(delta.isNotNull(), F.concat(F.lit('"updateDescription":{"updatedFields":'), F.coalesce(one_line(delta["updatedFields"]), F.lit("{}")), F.lit(',"removedFields":'), F.coalesce(F.to_json(delta["removedFields"]), F.lit("[]")), truncated, F.lit("}")))
    namespace = F.concat(F.lit('{"database":'), text(F.col("database")), F.lit(',"collection":'), text(F.col("collection")), F.lit("}"))
    time = F.date_format(F.to_utc_timestamp("cluster_time", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    members = F.concat_ws(",", part("operationType", text(F.col("operation"))), part("ns", namespace), part("documentKey", one_line(F.col("document_key"))), part("fullDocument", one_line(F.col("full_document"))), update, part("clusterTime", text(time)), part("_id", one_line(F.col("resume_token"))))
    return F.concat(F.lit("{"), members, F.lit("}"))
