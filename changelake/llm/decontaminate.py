"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over token positions; positions outside the mask are
ignored, so a substituted token does not break every seed that spans it.  Seeds
of the benchmark items are hashed into a sorted table, the same masks are rolled
over every training text, and equal hashes join.  Each hit puts a text and an
item on a common diagonal; along it, every window of ``OVERLAP`` tokens is
compared token by token, and the pair counts if one window agrees in at least
``AGREE`` of its places.  Items with fewer tokens, and at least ``SHORTEST``,
are one window.  The masks miss no window that counts: whatever places are
substituted, one mask fits between them (items under ``SHORT`` tokens have masks
of their own for that).  Items below ``SHORTEST`` are no evidence and never match,
unless ``shortest`` is set lower: then an item of that many tokens matches where
all of it stands in a text, by the hash of the whole item.

Tokens are runs of letters and digits, lower-cased (ASCII and Latin-1 capitals).

Scale: a benchmark of at most ``BLOCK`` bytes is sent to the executors with its
seeds (a few MB) and matched against all texts in one pass without a shuffle.
A larger one stays distributed: its seeds become a table, and a filter of at most
``FILTER`` bits of them; one pass over the texts sends on the places whose seeds
pass the filter, with the hashes of the tokens around them, and these join the
seeds by a shuffle.  Seeds with very many places are dealt to ``SPREAD`` tasks.  As a
window that counts holds a seed, it lies within the tokens sent.  No text is
shortened and no hit is dropped either way, and both give the same pairs.

Edge cases: null or empty texts and items never match; rows with the same key and
item are one pair, that of their best window; repeated texts are dropped alike; an
empty benchmark or table gives an empty result; further columns of any name are
passed through by ``clean`` and ignored by ``overlaps``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .scratch import Scratch

#: Positions that a mask keeps; each has weight 6.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 7, 8), (0, 2, 3, 6, 7, 9), (0, 1, 4, 5, 6, 10), (0, 3, 5, 6, 8, 9))
#: Further masks for items of fewer than ``SHORT`` tokens, where the others leave some substitutions without a fit.
SHORT_MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 7, 8))
SHORT = 12
OVERLAP, AGREE, SHORTEST, BLOCK = 13, 0.8, 8, 300_000
SPREAD, FILTER = 16, (1 << 16, 1 << 26)
_BITS = 22
_U = np.uint64


def _rolled(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The hash of the masked tokens from each position on."""
    m = max(0, len(h) - mask[-1])
    acc = np.full(m, salt, _U)
    for j in mask:
        acc *= _U(0xD1342543DE82EF95)
        acc += h[j : j + m]
    return tokens.mix(acc)


def _inside(at: np.ndarray, pos: np.ndarray, span: int) -> np.ndarray:
    """Whether pos to pos + span lies within one text; and which."""
    doc = np.searchsorted(at, pos, side="right") - 1
    return pos + span < at[doc + 1]


def _kinds(shortest: int) -> list[tuple[tuple[int, ...], int, int]]:
    """Each mask, and the least and greatest length of items that it is for."""
    return [*((m, SHORTEST, 1 << 40) for m in MASKS), *((m, SHORTEST, SHORT - 1) for m in SHORT_MASKS), *((tuple(range(k)), k, k) for k in range(max(1, shortest), SHORTEST))]


def _least(n: int, size: int) -> int:
    """How many tokens of a window must agree, for an item of n tokens."""
    return int(np.ceil(AGREE * size - 1e-9)) if n >= SHORTEST else n


class Block:
    """Some benchmark items with their seed table."""

    def __init__(self, items: list[tuple[int, bytes]], shortest: int = SHORTEST):
        w = tokens.hash_words([t for _, t in items], tokens.ALNUM, fold=True)
        self.ids, self.at, self.h = [i for i, _ in items], w.at, w.hashes
        seeds, places = [], []
        n = np.diff(self.at)
        self.masks = []
        for k, (mask, low, high) in enumerate(_kinds(shortest)):
            if not ((n >= low) & (n <= high)).any():
                continue
            self.masks.append((k, mask))
            s = _rolled(self.h, mask, k)
            ok = np.flatnonzero(_inside(self.at, np.arange(len(s)), mask[-1])) if len(s) else np.array([], int)
            size = n[np.searchsorted(self.at, ok, side="right") - 1]
            ok = ok[(size >= low) & (size <= high)]
            seeds.append(s[ok])
            places.append(ok)
        seeds, places = np.concatenate([np.array([], _U), *seeds]), np.concatenate([np.array([], np.int64), *places])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places = seeds[order], places[order].astype(np.int64)

    def filter(self) -> np.ndarray:
        maybe = np.zeros(1 << _BITS, bool)
        maybe[(self.seeds >> _U(64 - _BITS)).astype(np.int64)] = True
        return maybe

    def match(self, w: tokens.Words, maybe: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, agreeing tokens, window) of verified overlaps, by text and item."""
        doc_pos, item_pos = [], []
        for k, mask in self.masks:
            s = _rolled(w.hashes, mask, k)
            near = np.flatnonzero(maybe[(s >> _U(64 - _BITS)).astype(np.int64)])
            low = np.searchsorted(self.seeds, s[near], "left")
            count = np.searchsorted(self.seeds, s[near], "right") - low
            near, low, count = near[count > 0], low[count > 0], count[count > 0]
            if not near.size:
                continue
            ok = _inside(w.at, near, mask[-1])
            near, low, count = near[ok], low[ok], count[ok]
            doc_pos.append(np.repeat(near, count))
            item_pos.append(self.places[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())])
        if not doc_pos:
            return
        p, q = np.concatenate(doc_pos), np.concatenate(item_pos)
        doc, item = np.searchsorted(w.at, p, "right") - 1, np.searchsorted(self.at, q, "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, shift in np.unique(np.stack([doc, item, p - q]), axis=1).T.tolist():
            n = int(self.at[i + 1] - self.at[i])
            size = min(n, OVERLAP)
            a = max(self.at[i], w.at[d] - shift)
            b = min(self.at[i + 1], w.at[d + 1] - shift)
            if b - a < size:
                continue
            same = np.concatenate([[0], np.cumsum(self.h[a:b] == w.hashes[a + shift : b + shift])])
            agree = int((same[size:] - same[:-size]).max())
            if agree >= _least(n, size):
                best[d, i] = max(best.get((d, i), (0, 0)), (agree, size))
        for (d, i), (agree, size) in sorted(best.items()):
            yield d, i, agree, size


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = BLOCK, *, shortest: int = SHORTEST) -> Iterator[Block]:
    """The benchmark in blocks of at most ``size`` bytes, one item at least."""
    part, n = [], 0
    for i, t in benchmark.where(F.col(text).isNotNull()).select(item, F.col(text).cast("binary")).toLocalIterator():
        if part and n + len(t) > size:
            yield Block(part, shortest)
            part, n = [], 0
        part.append((i, bytes(t)))
        n += len(t)
    if part:
        yield Block(part, shortest)


# --- a benchmark of any size -----------------------------------------------------------------


def _around(w: tokens.Words, i: int, pos: int, span: int) -> tuple[int, bytes]:
    """The hashes of the tokens of all windows of text i that hold a seed at pos, and the seed's place in them."""
    low, high = max(w.at[i], pos + span + 1 - OVERLAP), min(w.at[i + 1], pos + OVERLAP)
    return int(pos - low), w.hashes[low:high].tobytes()


def _item_seeds(shortest: int, item_type: pa.DataType):
    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for w in tokens.chunks(tokens.texts(b.column(1)), tokens.ALNUM, fold=True):
                n = np.diff(w.at)
                for k, (mask, low, high) in enumerate(_kinds(shortest)):
                    s = _rolled(w.hashes, mask, k)
                    ok = np.flatnonzero(_inside(w.at, np.arange(len(s)), mask[-1])) if len(s) else np.array([], int)
                    own = np.searchsorted(w.at, ok, side="right") - 1
                    keep = (n[own] >= low) & (n[own] <= high)
                    for p, i in zip(ok[keep].tolist(), own[keep].tolist(), strict=True):
                        rows.append((w.first + i, s[p : p + 1].view(np.int64)[0], *_around(w, i, p, mask[-1]), int(n[i])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())).cast(item_type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.int32())], ["item", "seed", "item_at", "item_tokens", "n"])

    return run


def _text_seeds(shortest: int, bits: np.ndarray, shift: int):
    def run(batches):
        for b in batches:
            for w in tokens.chunks(tokens.texts(b.column(b.num_columns - 1)), tokens.ALNUM, fold=True):
                rows: list[tuple] = []
                for k, (mask, _, _) in enumerate(_kinds(shortest)):
                    s = _rolled(w.hashes, mask, k)
                    h = (s >> _U(shift)).astype(np.int64)
                    near = np.flatnonzero((bits[h >> 6] >> (h & 63)) & 1)
                    near = near[_inside(w.at, near, mask[-1])] if near.size else near
                    own = np.searchsorted(w.at, near, side="right") - 1
                    rows += [(w.first + i, s[p : p + 1].view(np.int64)[0], *_around(w, i, p, mask[-1])) for p, i in zip(near.tolist(), own.tolist(), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())], ["key", "seed", "at", "tokens"])

    return run


def _verified(batches):
    for b in batches:
        columns = [c.to_pylist() for c in b.columns[2:]]
        ok, agree_, size_ = [], [], []
        for r, (at, text, item_at, item, n) in enumerate(zip(*columns, strict=True)):
            x, y = np.frombuffer(text, _U), np.frombuffer(item, _U)
            before = min(at, item_at)
            after, size = min(len(x) - at, len(y) - item_at), min(n, OVERLAP)
            if before + after < size:
                continue
            same = np.concatenate([[0], np.cumsum(x[at - before : at + after] == y[item_at - before : item_at + after])])
            agree = int((same[size:] - same[:-size]).max())
            if agree >= _least(n, size):
                ok.append(r)
                agree_.append(agree)
                size_.append(size)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok, pa.int64())), b.column(1).take(pa.array(ok, pa.int64())), pa.array(agree_, pa.int32()), pa.array(size_, pa.int32())], ["key", "item", "agree", "size"])


def _joined(keyed: DataFrame, benchmark: DataFrame, item: str, shortest: int) -> DataFrame:
    """(key, item, agree, size) of verified hits, for rows (key, text): one pass over the texts, seeds joined by a shuffle."""
    scratch = Scratch(keyed.sparkSession)
    kind, item_kind = keyed.schema[0].dataType, benchmark.schema[item].dataType
    items = benchmark.where(F.col("text").isNotNull()).select(F.col(item), F.col("text").cast("binary"))
    seeds = scratch.save(items.mapInArrow(_item_seeds(shortest, to_arrow_type(item_kind)), f"item {item_kind.simpleString()}, seed long, item_at int, item_tokens binary, n int"))
    width = min(FILTER[1], max(FILTER[0], 1 << int(8 * seeds.count()).bit_length()))
    shift = 65 - width.bit_length()
    # A word of 64 bits for each place that occurs, put together by the executors: at most 8 MB.
    place = F.shiftrightunsigned("seed", shift)
    words = seeds.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).cast("long").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits"))
    bits = np.zeros(width // 64, np.int64)
    for r in words.mapInArrow(_packed, "at binary, bits binary").toLocalIterator():
        bits[np.frombuffer(bytes(r[0]), np.int64)] = np.frombuffer(bytes(r[1]), np.int64)
    hits = keyed.mapInArrow(_text_seeds(shortest, bits, shift), f"key {kind.simpleString()}, seed long, at int, tokens binary")
    hits = hits.withColumn("part", F.pmod(F.xxhash64("tokens", "at"), F.lit(SPREAD)).cast("int"))
    spread = seeds.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = hits.join(spread, ["seed", "part"]).select("key", "item", "at", "tokens", "item_at", "item_tokens", "n")
    return met.mapInArrow(_verified, f"key {kind.simpleString()}, item {item_kind.simpleString()}, agree int, size int")


def _packed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in b.columns], b.schema.names)


def _single(benchmark: DataFrame, item: str, shortest: int) -> tuple[Block | None, bool]:
    """The benchmark as one block, if it is no larger; and whether it is larger."""
    first = list(itertools.islice(blocks(benchmark, item, shortest=shortest), 2))
    return (first[0] if first else None), len(first) > 1


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", shortest: int = SHORTEST) -> DataFrame:
    """Pairs (key, item, agree, size): the best window of each text and item that overlap."""
    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind, item_kind = chosen.schema[0].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    block, larger = _single(benchmark, item, shortest)
    if block is None:
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, `{item}` {item_kind}, agree int, size int")
    if larger:
        found = _joined(chosen, benchmark, item, shortest)
    else:

        def run(batches):
            maybe = block.filter()
            for b in batches:
                rows = [(w.first + d, i, agree, size) for w in tokens.chunks(tokens.texts(b.column(1)), tokens.ALNUM, fold=True) for d, i, agree, size in block.match(w, maybe)]
                if rows:
                    made = [pa.array([block.ids[r[1]] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows])), *made], ["key", "item", "agree", "size"])

        found = chosen.mapInArrow(run, f"key {kind}, item {item_kind}, agree int, size int")
    best = found.groupBy("key", "item").agg(F.max(F.struct("agree", "size")).alias("best"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "best.agree", "best.size")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no benchmark item."""
    block, larger = _single(benchmark, item, shortest)
    if block is None:
        return docs
    name = tokens.free_name(docs.columns)
    if larger:  # texts go by their digests, as many may share a key
        named = docs.withColumn(name, F.md5(F.col(text).cast("binary")))
        found = _joined(named.select(F.col(name).alias("key"), F.col(text).cast("binary").alias("text")), benchmark, item, shortest)
        bad = Scratch(docs.sparkSession).save(found.select(F.col("key").alias(name)).distinct())
        return named.join(bad, name, "left_anti").select(*docs.columns)

    def run(batches):
        maybe = block.filter()
        for b in batches:
            bad = {w.first + d for w in tokens.chunks(tokens.texts(b.column(b.num_columns - 1)), tokens.ALNUM, fold=True) for d, *_ in block.match(w, maybe)}
            kept = pa.array([i not in bad for i in range(b.num_rows)])
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in b.columns[:-1]], b.schema.names[:-1])

    return docs.withColumn(name, F.col(text).cast("binary")).mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens.small_batches(spark)
    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "agree", "size")


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES: dict[str, str] = {}
