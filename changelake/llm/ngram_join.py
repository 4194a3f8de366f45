"""Exact Jaccard self-join of word shingles, by signature trees.

A text is the set of its distinct ``WORDS``-word shingles.  Texts whose sets
have a Jaccard similarity of ``PERCENT`` or more are linked, and documents get
the smallest key that links reach.  Nothing is approximate: all pairs that could
be linked meet.

1. One pass computes each set's size, digest and token bitmap.  Equal digests are
   one class from here on, so copies are counted, not joined.  The same pass
   counts shingles that come often.
2. Two linked sets share a shingle among the first ``n - ceil(t n) + 1`` of each,
   in any fixed order of all shingles; often-seen ones come last in ours.  Those
   shingles are packed by hash partition, and classes that share one form a
   cluster under their smallest digest.
3. Each cluster becomes a signature tree: a node holds the OR of its members'
   bitmaps, the range of their sizes and the most tokens that fell together in a
   bit.  The tree is traversed against itself; a pair of nodes is pruned when
   even their largest possible overlap is too small, or their sizes differ too
   much.  Members left without a partner go.
4. For the rest the sets are compared, hash by hash.  A breadth-first search that
   only looks at members it has not reached yet gives a spanning forest of the
   links, so a group of copies costs its size, not its square.
5. Links between classes make components, by minimum labels with jumps.

Hashes of shingles have 64 bits, and 48 where sets are compared, so a wrong link is
a matter of chance for texts that nobody built to collide.

Scale: no step emits pairs.  A cluster of more than ``SPLIT`` members is dealt into
blocks of about ``BLOCK``, each member in one.  While looking for partners, members
that find one in their block are settled; only the others, the open ones, meet all
blocks.  While comparing, every block holds the same few pivots too; members that
their block's links connect with the cluster's commonest pivot are in one
component already and needn't meet each other, so again only the others are open.
Open members and all members meet in blocks of ``MEET``.  A large group of near
copies thus sends each set about once, and a large cluster without links as often as
its members fill blocks of ``MEET``; all of it is exact.  A shingle of more
than ``SALT`` classes makes its cluster directly, without meeting in one task.
Intermediate tables lie in the shared checkpoint folder.

Edge cases: a text of fewer than WORDS words has one shingle, all of it; null
texts and texts without words have none, and stand alone; rows with the same key
and text are alike; a null key never is a component's name unless it stands
alone; keys may be of any type that has an order; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .scratch import Scratch

WORDS, PERCENT = 5, 75
SPLIT, BLOCK, PIVOTS, MEET, SALT = 256, 128, 8, 512, 200_000
SPREAD = 16
#: Shingles pooled before counting, how often one must come there, and how many of the most frequent are moved last.
POOL, OFTEN, HOT = 1 << 22, 2, 1 << 17
GROUP_KEYS, CHUNK_KEYS = 3_000_000, 400_000
#: Bits of the filter of keys whose texts are read again: a power of two by their number, up to 16 MB.
BLOOM = (1 << 16, 1 << 27)
_U = np.uint64


def _sets(values: list[bytes]) -> Iterator[tuple[int, np.ndarray, bytes | None]]:
    """Index, sorted set and digest of each text; no digest for an empty set."""
    for w in tokens.chunks(values):
        s, at = tokens.shingles(w, WORDS)
        for i in range(len(w)):
            u = np.unique(s[at[i] : at[i + 1]])
            yield w.first + i, u, hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None


def _six(u: np.ndarray) -> bytes:
    """A set for comparing: six bytes of each hash, of which any two texts' differ but once in 10**8 pairs."""
    return u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def bitmap(u: np.ndarray) -> bytes:
    """Two bits or more a token, as a power of two from 2**8 to 2**14."""
    k = min(14, max(8, int(2 * len(u) - 1).bit_length()))
    bits = np.zeros(1 << k, np.uint8)
    bits[(u & _U((1 << k) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def needed_overlap(a, b):
    """The least intersection of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


# --- pass 1: classes and frequent shingles -------------------------------------------------


def _frequent(pool: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.unique(np.concatenate(pool), return_counts=True)
    return h[c >= OFTEN].view(np.int64), c[c >= OFTEN]


def _summaries(key_type: pa.DataType):
    names = ["key", "n", "d", "bits", "hash", "seen"]
    types = [key_type, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def rows(*columns) -> pa.RecordBatch:
        size = next(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches):
        known: set[bytes] = set()
        pool, held = [], 0
        for b in batches:
            n, d, bits = [], [], []
            for _, u, digest in _sets(tokens.texts(b.column(1))):
                new = digest is not None and digest not in known
                n.append(len(u))
                d.append(digest)
                bits.append(bitmap(u) if new else None)
                if new:
                    known.add(digest)
                    pool.append(u)
                    held += len(u)
            yield rows(b.column(0), n, d, bits, None, None)
            if held >= POOL:
                yield rows(None, None, None, None, *_frequent(pool))
                pool, held = [], 0
        if pool:
            yield rows(None, None, None, None, *_frequent(pool))

    return run


def _as_bytes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in b.columns], b.schema.names)


# --- pass 2: prefix shingles, packed by hash partition -------------------------------------


def _prefix(u: np.ndarray, hot: np.ndarray, rank: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set: rare ones by hash, then frequent ones by rank."""
    p = prefix_length(len(u))
    near = maybe[(u >> _U(48)).astype(np.int64)]
    if not near.any():
        return u[:p]
    at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
    is_hot = hot[at] == u
    cold = u[~is_hot]
    if len(cold) >= p:
        return cold[:p]
    last = at[is_hot]
    return np.concatenate([cold, hot[last[np.argsort(rank[last])]]])[:p]


def _packed_keys(groups: int, hot: np.ndarray, rank: np.ndarray, salted: np.ndarray):
    maybe = np.zeros(1 << 16, bool)
    maybe[(hot >> _U(48)).astype(np.int64)] = True
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["p", "direct", "digests", "counts", "keys"]

    def pack(digests: list[bytes], keys: list[np.ndarray], turn: int) -> pa.RecordBatch:
        every = np.concatenate(keys)
        own = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        out = []
        if len(salted):
            direct = np.isin(every, salted)
            for key in np.unique(every[direct]).tolist():
                members = b"".join(digests[i] for i in own[direct & (every == _U(key))])
                out.append(((key + turn) % groups, np.array([key], _U).view(np.int64)[0].item(), members, b"", b""))
            every, own = every[~direct], own[~direct]
        p = ((every >> _U(32)) % _U(groups)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        every, own, p = every[order].astype(np.uint32), own[order], p[order]
        edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            who, count = np.unique(own[a:b], return_counts=True)  # own is ascending within p
            out.append((int(p[a]), None, b"".join(digests[i] for i in who), count.astype(np.uint32).tobytes(), every[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    def run(batches):
        known: set[bytes] = set()
        digests, keys, held, turn = [], [], 0, 0
        for b in batches:
            for _, u, digest in _sets(tokens.texts(b.column(0))):
                if digest is None or digest in known:
                    continue
                known.add(digest)
                digests.append(digest)
                keys.append(_prefix(u, hot, rank, maybe))
                held += len(keys[-1])
                if held >= CHUNK_KEYS:
                    yield pack(digests, keys, turn)
                    digests, keys, held, turn = [], [], 0, turn + 1
        if keys:
            yield pack(digests, keys, turn)

    return run


def _clusters_of(table: pa.Table) -> pa.Table:
    """Classes that share a shingle, under the smallest digest: one hash partition."""
    centre, member = [], []
    parts = []
    for direct, digests, counts, keys in zip(*(table.column(c).to_pylist() for c in ("direct", "digests", "counts", "keys")), strict=True):
        if direct is not None:
            name = hashlib.blake2b(direct.to_bytes(8, "little", signed=True), digest_size=16, person=b"shingle").digest()
            for i in range(0, len(digests), 16):
                centre.append(name)
                member.append(digests[i : i + 16])
        else:
            parts.append((np.frombuffer(digests, ">u8").reshape(-1, 2), np.frombuffer(counts, np.uint32), np.frombuffer(keys, np.uint32)))
    if parts:
        digests = np.concatenate([p[0] for p in parts])
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        ranked = digests[order]
        new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)])
        ids = np.empty(len(order), _U)
        ids[order] = (np.cumsum(new) - 1).astype(_U)
        names = ranked[new].astype(">u8").tobytes()
        own = np.repeat(ids, np.concatenate([p[1] for p in parts]))
        both = np.unique(np.concatenate([p[2] for p in parts]).astype(_U) << _U(32) | own)
        key, own = both >> _U(32), both & _U(0xFFFFFFFF)
        first = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.diff(np.append(np.flatnonzero(first), len(key)))
        pairs = np.unique((np.repeat(own[first], size) << _U(32) | own)[np.repeat(size > 1, size)])
        centre += [names[16 * i : 16 * i + 16] for i in (pairs >> _U(32)).tolist()]
        member += [names[16 * i : 16 * i + 16] for i in (pairs & _U(0xFFFFFFFF)).tolist()]
    return pa.table({"centre": pa.array(centre, pa.binary()), "member": pa.array(member, pa.binary())})


# --- clusters in tasks ---------------------------------------------------------------------


def _without_parts(clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """``clusters`` without those that lie whole within another: all of their members have that one as their largest.

    The other one stays, as these members are its own too.
    """
    sizes = clusters.groupBy("centre").agg(F.count(F.lit(1)).alias("size"))
    sized = clusters.join(sizes, "centre").select("member", "centre", "size")
    largest = sized.groupBy("member").agg(F.max(F.struct("size", "centre"))["centre"].alias("largest"))
    whole = clusters.join(largest, "member").groupBy("centre").agg(F.min("largest").alias("a"), F.max("largest").alias("b")).where("a <> b OR a = centre").select("centre")
    return scratch.save(clusters.join(whole, "centre", "left_semi").select(*clusters.columns))


def _large(clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """(centre, members) of clusters with more than SPLIT members: few rows, written so that joins know their size."""
    return scratch.save(clusters.groupBy("centre").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > SPLIT))


def _dealt(clusters: DataFrame, large: DataFrame, pivots: int = 0) -> DataFrame:
    """Add block, parted and own: one block for each member, and for pivots of a large cluster all of its blocks."""
    all_ = clusters.join(large, "centre", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("int"))
    all_ = all_.withColumn("mine", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    parted = F.col("members").isNotNull()
    if pivots:
        pivot = parted & (F.pmod(F.xxhash64(F.lit("pivot"), "member"), F.greatest(F.lit(1), F.floor(F.col("members") / pivots))) == 0)
        all_ = all_.withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine")))).withColumn("pivot", pivot)
    else:
        all_ = all_.withColumn("block", F.col("mine")).withColumn("pivot", F.lit(False))
    return all_.select(*clusters.columns, "block", parted.alias("parted"), (F.col("block") == F.col("mine")).alias("own"), "pivot")


def _meeting(clusters: DataFrame, large: DataFrame, opened: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(centre, i, j, member, open): blocks of open members of large clusters, each with every block of all members."""
    sizes = opened.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).join(large, "centre")
    sizes = scratch.save(sizes.select("centre", F.ceil(F.col("n") / MEET).cast("int").alias("us"), F.ceil(F.col("members") / MEET).cast("int").alias("vs")))
    if sizes.isEmpty():
        return None
    mine, to = lambda n: F.pmod(F.xxhash64("member"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    us = opened.join(sizes, "centre").select("centre", mine("us").alias("i"), to("vs").alias("j"), "member", F.lit(True).alias("open"))
    vs = clusters.join(sizes, "centre").select("centre", to("us").alias("i"), mine("vs").alias("j"), "member", F.lit(False).alias("open"))
    return scratch.save(us.unionByName(vs))  # mostly few narrow rows: written, so that joins know their size


def _groups(batches, keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Key and columns of each group of rows alike in the first ``keys`` columns, by which batches are sorted."""
    last, held = None, None
    for b in batches:
        values = [c.to_pylist() for c in b.columns]
        for row in zip(*values, strict=True):
            if row[:keys] != last:
                if held:
                    yield last, held
                last, held = row[:keys], [[] for _ in row[keys:]]
            for h, v in zip(held, row[keys:], strict=True):
                h.append(v)
    if held:
        yield last, held


class Tree:
    """A signature tree over bitmaps of one length; children of node x of a level are FAN * x and following."""

    FAN = 8

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        pop = np.bitwise_count(bits).sum(1).astype(np.int64)
        # low and high: sizes; pop: fewest bits; spare: most tokens that share bits with others.
        self.levels = [(bits, sizes, sizes, pop, sizes - pop)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), self.FAN)
            ors, low, high, pop, spare = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(ors, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(pop, at), np.maximum.reduceat(spare, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether nodes a and b may hold a linked pair, by the largest overlap they allow."""
        ors, low, high, pop, spare = self.levels[level]
        common = np.bitwise_count(ors[a] & ors[b]).sum(1).astype(np.int64)
        most = np.minimum(np.minimum(high[a], high[b]), common + np.minimum(spare[a], spare[b]))
        if level == 0:
            most = np.minimum(high[a] - np.maximum(0, pop[a] - common), high[b] - np.maximum(0, pop[b] - common))
        fits = (100 * high[a] >= PERCENT * low[b]) & (100 * high[b] >= PERCENT * low[a])
        return fits & (most >= needed_overlap(low[a], low[b]))

    def partnered(self, wanted: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """Members that have a possible partner; only pairs with a ``wanted`` and an open member count."""
        n = len(wanted)
        found = np.zeros(n, bool)
        a = b = np.zeros(1, np.int64)
        todo = [(len(self.levels) - 1, a, b)]
        while todo:
            level, a, b = todo.pop()
            if len(a) > 1 << 15:
                half = len(a) // 2
                todo += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            if level == 0:
                ok = a != b
                a, b = a[ok], b[ok]
                ok = (wanted[a] | wanted[b]) & (opened[a] | opened[b]) & ~(found[a] & found[b])
                a, b = a[ok], b[ok]
                ok = self.possible(0, a, b)
                found[a[ok]] = found[b[ok]] = True
                continue
            ok = (a == b) | self.possible(level, a, b)
            a, b = a[ok], b[ok]
            step = np.arange(self.FAN)
            shape = (len(a), self.FAN, self.FAN)
            x = np.broadcast_to((self.FAN * a)[:, None, None] + step[:, None], shape).ravel()
            y = np.broadcast_to((self.FAN * b)[:, None, None] + step, shape).ravel()
            ok = (x <= y) & (y < len(self.levels[level - 1][0]))
            todo.append((level - 1, x[ok], y[ok]))
        return found


def partners(sizes: np.ndarray, bits: list[bytes], opened: np.ndarray | None = None) -> np.ndarray:
    """Which members of a cluster may be linked to another (an open one, or open themselves): a tree for each bitmap length and the next longer."""
    opened = np.ones(len(bits), bool) if opened is None else opened
    length = np.array([len(x) for x in bits])
    found = np.zeros(len(bits), bool)
    for size in np.unique(length).tolist():
        at = np.flatnonzero((length == size) | (length == 2 * size))
        if len(at) < 2:
            continue
        rows = np.empty((len(at), size), np.uint8)
        for r, i in enumerate(at):
            x = np.frombuffer(bits[i], np.uint8)
            rows[r] = x if len(x) == size else x[:size] | x[size:]
        order = np.argsort(sizes[at], kind="stable")
        at = at[order]
        found[at] |= Tree(sizes[at], rows[order].view(_U)).partnered(length[at] == size, opened[at])
    return found


_FOUND = ["centre", "member", "found"]


def _found(batches):
    """(centre, member, found) of blocks: members with a possible partner in their block; of large clusters, the others too."""
    rows: list[tuple] = []
    for (centre, _), (members, n, bits, parted) in _groups(batches, 2):
        ok = partners(np.array(n, np.int64), bits)
        rows += [(centre, m, bool(o)) for m, o in zip(members, ok, strict=True) if o or parted[0]]
        if len(rows) > 10_000:
            yield _table(rows, _FOUND)
            rows = []
    yield _table(rows, _FOUND)


def _found_open(batches):
    """(centre, member, found) of open members and those that they may be linked to."""
    for (centre, _, _), (members, n, bits, opened) in _groups(batches, 3):
        one = {m: (a, b, o) for o in (False, True) for m, a, b, x in zip(members, n, bits, opened, strict=True) if x == o}
        ok = partners(np.array([a for a, _, _ in one.values()], np.int64), [b for _, b, _ in one.values()], np.array([o for _, _, o in one.values()]))
        yield _table([(centre, m, True) for m, o in zip(one, ok, strict=True) if o], _FOUND)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"found": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(c, pa.binary())) for k, c in enumerate(names)], names)


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets, compared exactly.

    Overlaps of one set with all members not reached yet come from an inverted
    index, which is rebuilt without the reached ones as they become many.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        inter = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if inter >= needed_overlap(size[0], size[1]) else []
    every = np.concatenate(sets)
    _, ids = np.unique(every, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(m), size)
    left = np.ones(m, bool)
    edges: list[tuple[int, int]] = []

    def index():
        keep = left[owner]
        i, o = ids[keep], owner[keep]
        order = np.argsort(i, kind="stable")
        start = np.zeros(ids.max() + 2, np.int64)
        np.cumsum(np.bincount(i, minlength=ids.max() + 1), out=start[1:])
        return start, o[order], int(left.sum())

    start, posting, indexed = index()
    for root in range(m):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            if (remaining := int(left.sum())) == 0:
                break
            if remaining < indexed // 2:
                start, posting, indexed = index()
            own = ids[at[x] : at[x + 1]]
            a, n = start[own], start[own + 1] - start[own]
            hits = posting[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
            inter = np.bincount(hits, minlength=m)
            for y in np.flatnonzero(left & (inter > 0) & (inter >= needed_overlap(size[x], size))).tolist():
                left[y] = False
                edges.append((x, y))
                queue.append(y)
    return edges


_LINKS = ["a", "b", "centre", "member", "label"]


def _forest(names: list[bytes], sets: list[bytes]) -> list[tuple[bytes, bytes]]:
    if len(names) < 2:
        return []
    return [(names[x], names[y]) for x, y in spanning_links([_from_six(s) for s in sets])]


def _links(batches):
    """Links (a, b) within blocks; of large clusters also (centre, member, label), the least pivot that a member is connected with."""
    for (centre, _), (members, sets, parted, own, pivot) in _groups(batches, 2):
        one = dict(sorted(zip(members, zip(sets, own, pivot, strict=True), strict=True)))
        edges = _forest(list(one), [x[0] for x in one.values()])
        rows: list[tuple] = [(a, b, None, None, None) for a, b in edges]
        if parted[0]:
            parent = {m: m for m in one}

            def root(m, parent=parent):
                while parent[m] != m:
                    parent[m] = parent[parent[m]]
                    m = parent[m]
                return m

            for a, b in edges:
                parent[root(a)] = root(b)
            label: dict[bytes, bytes] = {}
            for m, (_, _, is_pivot) in one.items():  # in ascending order
                if is_pivot:
                    label.setdefault(root(m), m)
            rows += [(None, None, centre, m, label.get(root(m))) for m, (_, mine, _) in one.items() if mine]
        yield _table(rows, _LINKS)


def _links_open(batches):
    """Links (a, b) of open members with all members of a block."""
    for _, (members, sets) in _groups(batches, 3):
        one = dict(sorted(zip(members, sets, strict=True)))
        yield _table(_forest(list(one), list(one.values())), _LINKS[:2])


def _bloom(keys: DataFrame, size: int) -> np.ndarray:
    """A bit for each place that occurs, put together by the executors."""
    packed = keys.select(F.floor(F.col("place") / 64).cast("long").alias("at"), F.expr("shiftleft(1L, place % 64)").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(size // 64, np.int64)
    for r in packed.mapInArrow(_as_bytes, "at binary, bits binary").toLocalIterator():
        out[np.frombuffer(bytes(r[0]), np.int64)] = np.frombuffer(bytes(r[1]), np.int64)
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of links (a, b): the smallest node of its component."""
    edges = scratch.save(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        # Labels that have moved on themselves; a label of very many nodes is joined in SPREAD parts.
        heads = lower.select("label").distinct().join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").where(F.col("far") < F.col("label"))
        jump = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        parted = lower.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int"))
        new = scratch.save(parted.join(jump, ["label", "part"], "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "was"))
        scratch.drop(labels)
        labels = new
        if not labels.where(F.col("label") != F.col("was")).limit(1).count():
            scratch.drop(edges)
            return labels.select("node", "label")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``.

    Two small tables in the scratch folder outlive the call, as the result reads
    them: digests and names of components; they go with the folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind, arrow = source.schema["key"].dataType.simpleString(), to_arrow_type(source.schema["key"].dataType)

    told = scratch.save(source.mapInArrow(_summaries(arrow), f"key {kind}, n long, d binary, bits binary, hash long, seen long"))
    rows = told.where(F.col("n").isNotNull()).select("key", "n", "d", "bits")
    classes = scratch.save(rows.where("n > 0").groupBy("d").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits")))
    total = classes.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0]
    if total is None:
        return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))

    # At most HOT shingles and counts, however many rows there are; any order of them is right.
    often = told.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "hash").limit(HOT)
    found = [(bytes(r[0]), bytes(r[1])) for r in often.mapInArrow(_as_bytes, "hash binary, seen binary").collect()]
    hot = np.frombuffer(b"".join(r[0] for r in found), _U)
    seen = np.frombuffer(b"".join(r[1] for r in found), np.int64)
    order = np.argsort(hot)
    hot, seen = hot[order], seen[order]
    rank = np.empty(len(hot), np.int64)
    rank[np.lexsort((hot, seen))] = np.arange(len(hot))
    groups = max(8, -(-int(total) // GROUP_KEYS))

    packed = source.select("text").mapInArrow(_packed_keys(groups, hot, rank, hot[seen >= SALT]), "p long, direct long, digests binary, counts binary, keys binary")
    met = scratch.save(packed.groupBy("p").applyInArrow(_clusters_of, "centre binary, member binary").distinct())
    clusters = _without_parts(met, scratch)
    scratch.drop(met)

    large, about = _large(clusters, scratch), classes.select(F.col("d").alias("member"), "n", "bits")
    signed = _dealt(clusters, large).join(about, "member").select("centre", "block", "member", "n", "bits", "parted")
    first = scratch.save(signed.repartition("centre", "block").sortWithinPartitions("centre", "block").mapInArrow(_found, "centre binary, member binary, found boolean"))
    partnered = first.where("found").select("centre", "member")
    meeting = _meeting(clusters, large, first.where("NOT found").select("centre", "member"), scratch)
    if meeting is not None:
        signed = meeting.join(about, "member").select("centre", "i", "j", "member", "n", "bits", "open")
        more = signed.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j").mapInArrow(_found_open, "centre binary, member binary, found boolean")
        partnered = partnered.unionByName(more.select("centre", "member")).distinct()
    kept = scratch.save(partnered)
    scratch.drop(clusters, first, large)

    needed = scratch.save(kept.select(F.col("member").alias("d")).distinct().join(classes.select("d", "rep"), "d"))
    size = min(BLOOM[1], max(BLOOM[0], 1 << int(64 * needed.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    bits = _bloom(needed.select(place("rep").alias("place")), size)

    def wanted_sets(batches):
        known: set[tuple] = set()
        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1))
            out = []
            keys = b.column(0).to_pylist()
            for i, u, digest in _sets(tokens.texts(b.column(2))):
                if digest is not None and (keys[i], digest) not in known:
                    known.add((keys[i], digest))
                    out.append((i, digest, _six(u)))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in out])), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], ["key", "d", "set"])

    found = source.select("key", place("key").alias("h"), "text").mapInArrow(wanted_sets, f"key {kind}, d binary, set binary")
    # The sets as read: some that nobody asked for pass the filter, and a repeated row gives its set again; both don't matter.
    sets = scratch.save(found.select(F.col("d").alias("member"), "key", "set"))
    asked = needed.select(F.col("d").alias("member"), F.col("rep").alias("key"))
    large = _large(kept, scratch)
    kept_of = kept.join(asked, "member")
    on = lambda rows: rows.join(sets.withColumnRenamed("key", "of"), "member").where(F.col("key").eqNullSafe(F.col("of")))
    compared = on(_dealt(kept_of, large, PIVOTS)).select("centre", "block", "member", "set", "parted", "own", "pivot").repartition("centre", "block").sortWithinPartitions("centre", "block")
    links = scratch.save(compared.mapInArrow(_links, ", ".join(f"{c} binary" for c in _LINKS)))
    edges = links.where(F.col("a").isNotNull()).select("a", "b")
    if not large.isEmpty():
        told_labels = links.where(F.col("member").isNotNull())
        best = told_labels.where(F.col("label").isNotNull()).groupBy("centre", "label").count().groupBy("centre").agg(F.max_by("label", F.struct("count", "label")).alias("best"))
        opened = told_labels.join(best, "centre", "left").where(F.coalesce(F.col("label") != F.col("best"), F.lit(True))).select("centre", "member")
        meeting = _meeting(kept, large, opened, scratch)
        if meeting is not None:
            compared = on(scratch.save(meeting.join(asked, "member"))).select("centre", "i", "j", "member", "set").repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j")
            edges = edges.unionByName(compared.mapInArrow(_links_open, "a binary, b binary"))
    labels = components(edges, scratch)

    named = classes.select("d", "rep").join(labels.withColumnRenamed("node", "d"), "d")
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    named = named.join(least, "label").select("d", "least")
    names = scratch.save(classes.select("d", "rep").join(named, "d", "left").select("d", F.coalesce("least", "rep").alias("component_id")))
    scratch.drop(needed, kept, links, sets)
    out = rows.join(names, "d", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
    return out


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens.small_batches(spark)
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLES: dict[str, str] = {}
