"""Vectorised word hashing over Arrow batches, shared by the text operators.

A batch of texts is read as one byte buffer.  Word boundaries come from a byte
mask; the hash of each word is a difference of prefix sums of a polynomial, so
no Python object is made for a word.  Work goes in chunks of about ``CHUNK``
bytes (one text at least), which bounds memory whatever the batch size.
"""

from __future__ import annotations

import heapq
import io
import pathlib
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD1342543DE82EF95)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    table = _tables.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK), base, dtype=_U)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _tables[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _table(pairs) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(pairs)] = True
    return t


#: Words as runs of anything but the six ASCII white-space bytes.
NOT_SPACE = ~_table([0x20, *range(0x09, 0x0E)])
#: Words as runs of ASCII letters, digits and all non-ASCII bytes.
ALNUM = _table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
#: As ALNUM, without digits.
ALPHA = _table([*range(65, 91), *range(97, 123), *range(128, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower-case UTF-8 capitals of the Latin-1 block, byte for byte."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.array([], int)
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    data[at] += 0x20
    return data


@dataclass
class Words:
    """Hashes of the words of some texts; words of text i are at[i]:at[i + 1]."""

    hashes: np.ndarray
    at: np.ndarray
    start: np.ndarray  # byte offsets within ``data``
    end: np.ndarray
    data: np.ndarray
    first: int  # index of the first text within the batch

    def __len__(self) -> int:
        return len(self.at) - 1


def texts(column: pa.Array) -> list[bytes]:
    """The values as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def hash_words(values: list[bytes], word: np.ndarray = NOT_SPACE, fold: bool = False, first: int = 0) -> Words:
    """Hash the words of ``values``, with A-Z lower-cased."""
    size = np.fromiter((len(v) for v in values), np.int64, len(values))
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    data = _LOWER[np.frombuffer(b"".join(values), np.uint8)]
    if fold:
        data = fold_latin(data)
    n = len(data)
    inside = word[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[at] = False
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[at] = False
    start = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, n), out=total[1:])
    hashes = (total[end] - total[start]) * _powers(_INVERSE, n + 1)[start] if n else np.array([], _U)
    hashes = mix(hashes + (end - start).astype(_U) * _STEP)
    return Words(hashes, np.searchsorted(start, at), start, end, data, first)


def chunks(values: list[bytes], word: np.ndarray = NOT_SPACE, fold: bool = False) -> Iterator[Words]:
    """``hash_words`` over runs of about CHUNK bytes."""
    i = 0
    while i < len(values):
        j, n = i, 0
        while j < len(values) and (j == i or n + len(values[j]) <= CHUNK):
            n += len(values[j])
            j += 1
        yield hash_words(values[i:j], word, fold, i)
        i = j


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles, and where each text's begin.

    A text with fewer than k words, and at least one, has one shingle: all of it.
    """
    h, at = words.hashes, words.at
    m = max(0, len(h) - k + 1)
    rolled = np.zeros(m, _U)
    for j in range(k):
        rolled = rolled * _STEP + h[j : j + m]
    rolled = mix(rolled + _U(k))
    count = np.diff(at)
    kept = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    out_at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(kept, out=out_at[1:])
    out = np.empty(out_at[-1], _U)
    full = np.flatnonzero(count >= k)
    within = np.arange(kept[full].sum()) - np.repeat(np.cumsum(kept[full]) - kept[full], kept[full])
    out[np.repeat(out_at[full], kept[full]) + within] = rolled[np.repeat(at[full], kept[full]) + within]
    for i in np.flatnonzero((count > 0) & (count < k)):
        acc = np.zeros(1, _U)
        for x in h[at[i] : at[i + 1]]:
            acc = acc * _STEP + x
        out[out_at[i]] = mix(acc + _U(count[i]))[0]
    return out, out_at


class Lowest:
    """Items by head, up to the first with which there would be more than ``rows``, or ``size`` bytes of parts; one at least.

    ``barrier`` is the head of that first one: nothing from there on is held, whatever the order in which items come.
    """

    def __init__(self, rows: int, size: int):
        self.rows, self.size, self.held, self.bytes, self.turn, self.barrier = rows, size, [], 0, 0, None

    def takes(self, head: tuple) -> bool:
        """Whether an item of this head may stay."""
        return self.barrier is None or head < self.barrier

    def add(self, head: tuple, parts: tuple[bytes, ...]) -> None:
        if not self.takes(head):
            return
        self.turn += 1
        heapq.heappush(self.held, _Held(head, self.turn, parts))
        self.bytes += sum(map(len, parts))
        while len(self.held) > 1 and (len(self.held) > self.rows or self.bytes > self.size):
            last = heapq.heappop(self.held)
            self.bytes -= sum(map(len, last.parts))
            self.barrier = last.head if self.barrier is None else min(self.barrier, last.head)

    def items(self) -> list[tuple[tuple, tuple]]:
        return sorted((x.head, x.parts) for x in self.held)


@dataclass
class _Held:
    head: tuple
    turn: int
    parts: tuple

    def __lt__(self, other) -> bool:  # the highest head is the first of the heap
        return (self.head, self.turn) > (other.head, other.turn)


def free_name(columns: list[str], name: str = "__text") -> str:
    """``name``, with underscores added until none of ``columns`` has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark) -> None:
    """Send this package to the executors, once a session: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_changelake_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_text())
    path = pathlib.Path(tempfile.mkdtemp(), "changelake_package.zip")
    path.write_bytes(held.getvalue())
    context.addPyFile(str(path))
    context._changelake_shipped = True


def small_batches(spark, rows: int = 512, size: int = 8 << 20) -> None:
    """Ready a session: bound what goes to Python at once, as long texts must not meet in one batch."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
