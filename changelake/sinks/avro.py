"""Avro object container files for flat events, written and read without a Spark module."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = b"Obj\x01"
TEXT, OPTIONAL = "string", ["null", "string"]
SCHEMA = {
    "type": "record",
    "name": "ChangeEvent",
    "namespace": "changelake",
    "fields": [{"name": n, "type": t} for n, t in (("operation", TEXT), ("database", TEXT), ("collection", TEXT), ("cluster_time", TEXT), ("document_key", OPTIONAL), ("full_document", OPTIONAL), ("resume_token", TEXT))],
}
COLUMNS = [f["name"] for f in SCHEMA["fields"]]


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(b: bytes) -> bytes:
    return _long(len(b)) + b


def _value(kind, v: str | None) -> bytes:
    if kind == TEXT:
        return _bytes(v.encode())
    return _long(0) if v is None else _long(1) + _bytes(v.encode())


def _varint(n: Column) -> Column:
    """A length as a zig-zag variable-length integer; lengths are below 2 ** 34."""
    z = n.cast("long") * 2
    byte = lambda v: F.unhex(F.lpad(F.hex(v), 2, "0"))
    piece = lambda i, last: byte(F.shiftright(z, 7 * i).bitwiseAND(127) if last else F.shiftright(z, 7 * i).bitwiseAND(127).bitwiseOR(128))
    whole = lambda k: F.concat(*[piece(i, i == k - 1) for i in range(k)]) if k > 1 else piece(0, True)
    out = whole(5)
    for k in (4, 3, 2, 1):
        out = F.when(z < (1 << 7 * k), whole(k)).otherwise(out)
    return out


def row(columns: dict[str, Column] | None = None) -> Column:
    """A flat event as the bytes of one Avro record: all in expressions.  Optional texts are null where they are empty."""
    parts = []
    for f in SCHEMA["fields"]:
        c = (columns or {}).get(f["name"], F.col(f["name"])).cast("binary")
        text = F.concat(_varint(F.octet_length(c)), c)
        parts.append(text if f["type"] == TEXT else F.when(c.isNull() | (F.octet_length(c) == 0), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x02"), text)))
    return F.concat(*parts)


def encode(rows: Iterable[tuple], codec: str = "null", block: int = 4000) -> bytes:
    """Rows in the order of COLUMNS as one file."""
    kinds = [f["type"] for f in SCHEMA["fields"]]
    return assemble((b"".join(_value(k, v) for k, v in zip(kinds, row, strict=True)) for row in rows), codec, block)


def assemble(records: Iterable[bytes], codec: str = "null", block: int = 4000) -> bytes:
    """Encoded records as one file."""
    schema = json.dumps(SCHEMA, separators=(",", ":")).encode()
    sync = hashlib.md5(schema).digest()
    out = [MAGIC, _long(2), _bytes(b"avro.schema"), _bytes(schema), _bytes(b"avro.codec"), _bytes(codec.encode()), _long(0), sync]
    held: list[bytes] = []

    def flush() -> None:
        data = b"".join(held)
        if codec == "deflate":
            data = zlib.compress(data, wbits=-15)
        out.extend((_long(len(held)), _bytes(data), sync))
        held.clear()

    for record in records:
        held.append(record)
        if len(held) == block:
            flush()
    if held:
        flush()
    return b"".join(out)


class _Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)

    def bytes(self) -> bytes:
        return self.take(self.long())


def decode(data: bytes) -> Iterator[tuple]:
    """The rows of a file with string and optional string fields."""
    c = _Cursor(data)
    if c.take(4) != MAGIC:
        raise ValueError("not an Avro file")
    meta = {}
    while n := c.long():
        if n < 0:
            n = -n
            c.long()
        for _ in range(n):
            key = c.bytes().decode()
            meta[key] = c.bytes()
    sync = c.take(16)
    kinds = [f["type"] for f in json.loads(meta["avro.schema"])["fields"]]
    codec = meta.get("avro.codec", b"null").decode()
    while c.at < len(data):
        n, block = c.long(), c.bytes()
        if c.take(16) != sync:
            raise ValueError("broken Avro block")
        inner = _Cursor(zlib.decompress(block, wbits=-15) if codec == "deflate" else block)
        for _ in range(n):
            yield tuple(inner.bytes().decode() if k == TEXT or inner.long() else None for k in kinds)
