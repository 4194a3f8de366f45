"""``$match`` and ``$project`` stages as columns.

A stage becomes a Catalyst expression, so filters on plain columns reach the
scan.  Paths below ``fullDocument``, ``documentKey`` and ``updateDescription.
updatedFields`` are read from JSON.  Other stages are refused.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"operationType": "operation", "ns.db": "database", "ns.coll": "collection", "clusterTime": "cluster_time", "_id": "resume_token", "fullDocument": "full_document", "documentKey": "document_key"}
DOCUMENTS = {"fullDocument.": "full_document", "documentKey.": "document_key", "updateDescription.updatedFields.": "update_description.updatedFields"}


class UnsupportedStage(ValueError):
    """A stage or operator that has no column form here."""


def _path(path: str) -> tuple[Column, bool]:
    """The column of a path, and whether it is text taken from JSON."""
    if path in FIELDS:
        return F.col(FIELDS[path]), False
    for prefix, column in DOCUMENTS.items():
        if path.startswith(prefix):
            return F.get_json_object(F.col(column), "$." + path[len(prefix) :]), True
    raise UnsupportedStage(f"unknown field {path}")


def _typed(column: Column, is_json: bool, value: Any) -> Column:
    if not is_json or isinstance(value, str):
        return column
    if isinstance(value, bool):
        return column.try_cast("boolean")
    return column.try_cast("double" if isinstance(value, float) else "decimal(38,10)")


def _compare(path: str, op: str, value: Any) -> Column:
    column, is_json = _path(path)
    if op == "$exists":
        return column.isNotNull() if value else column.isNull()
    if op in ("$in", "$nin"):
        some = [v for v in value if v is not None]
        found = reduce(lambda a, b: a | b, [F.coalesce(_typed(column, is_json, v) == F.lit(v), F.lit(False)) for v in some], column.isNull() if None in value else F.lit(False))
        return found if op == "$in" else ~found
    if value is None:
        return {"$eq": column.isNull(), "$ne": column.isNotNull()}[op]
    typed = _typed(column, is_json, value)
    if op == "$ne":
        return F.coalesce(typed != F.lit(value), F.lit(True))
    compared = {"$eq": typed.__eq__, "$gt": typed.__gt__, "$gte": typed.__ge__, "$lt": typed.__lt__, "$lte": typed.__le__}
    if op not in compared:
        raise UnsupportedStage(f"unsupported operator {op}")
    return compared[op](F.lit(value))


def _condition(path: str, spec: Any) -> Column:
    if isinstance(spec, dict) and any(k.startswith("$") for k in spec):
        parts = [~F.coalesce(_condition(path, v), F.lit(False)) if k == "$not" else _compare(path, k, v) for k, v in spec.items()]
        return reduce(lambda a, b: a & b, parts)
    return _compare(path, "$eq", spec)


def match(stage: dict[str, Any]) -> Column:
    """The body of a ``$match`` as a condition."""
    parts = []
    for k, v in stage.items():
        if k == "$and":
            parts.append(reduce(lambda a, b: a & b, [match(x) for x in v]))
        elif k == "$or":
            parts.append(reduce(lambda a, b: a | b, [match(x) for x in v]))
        elif k == "$nor":
            parts.append(~reduce(lambda a, b: a | b, [F.coalesce(match(x), F.lit(False)) for x in v]))
        elif k.startswith("$"):
            raise UnsupportedStage(f"unsupported operator {k}")
        else:
            parts.append(_condition(k, v))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def project(stage: dict[str, Any]) -> list[Column]:
    """The body of an inclusive ``$project`` as columns, named by their last part unless renamed with "$path"."""
    out = []
    for k, v in stage.items():
        if v in (0, False):
            raise UnsupportedStage("exclusion in $project")
        source = v[1:] if isinstance(v, str) and v.startswith("$") else k
        out.append(_path(source)[0].alias(k.rpartition(".")[2]))
    return out


def apply(events: DataFrame, stages: list[dict[str, Any]]) -> DataFrame:
    """Run a pipeline of ``$match`` and ``$project`` stages."""
    for stage in stages:
        ((name, body),) = stage.items()
        if name == "$match":
            events = events.where(match(body))
        elif name == "$project":
            events = events.select(*project(body))
        else:
            raise UnsupportedStage(f"unsupported stage {name}")
    return events
