"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another: each logistic model sees the text's
features and the probabilities of all categories before it.  While training,
those come from out-of-fold predictions, so a later model learns from earlier
probabilities as unsure as they will be on new texts.

Features: counts of marker words and word beginnings (4 and 5 bytes), picked by
their association with any category, and a few measures of form.  Fitting uses
at most ``rows`` labelled texts with at most ``HELD`` bytes of features, those whose
key and text hash lowest; a rerun fits the same model.  Tasks cut to these
bounds before anything is sent on, whatever keys repeat.  Scoring is one pass over
whole texts without a shuffle; the model has a fixed size.

A category's threshold is the one with the best F1 on out-of-fold predictions,
but not below its share of the labels: with very few positive labels that F1 says
little, and a text no likelier than the average must not be flagged.

Edge cases: null or empty text has probability 0 in every category and is never
flagged; labels that are null count as 0; labelled keys without a text, and
texts without a label, don't train; a key with several labels is positive where any
of them is; a null key has no label; with one class only in the labels nothing is
flagged; repeated rows score alike; empty tables give an empty result; further
columns of any name are passed through by ``clean`` and don't matter to ``fit``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

ROWS, MARKERS, FOLDS = 4000, 400, 5
#: Most bytes of features that fitting gathers.
HELD = 64 << 20
_SALTS = (0x51ED2701, 0x2545F491, 0x9E3779B9)


def _hashes(w: tokens.Words) -> np.ndarray:
    """Three 32-bit hashes a word: the word, and its first 4 and 5 bytes."""
    out = np.empty((len(w.hashes), 3), np.uint32)
    out[:, 0] = (w.hashes >> np.uint64(32)).astype(np.uint32) ^ np.uint32(_SALTS[0])
    n = len(w.data)
    size = w.end - w.start
    for j, k in ((1, 4), (2, 5)):
        acc = np.zeros(len(size), np.uint64)
        for i in range(k):
            at = np.minimum(w.start + i, max(0, n - 1))
            acc = acc * np.uint64(257) + np.where(i < size, w.data[at], 0).astype(np.uint64)
        out[:, j] = (tokens.mix(acc + np.uint64(k << 56)) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(_SALTS[j])
    return out


def _form(w: tokens.Words, sizes: np.ndarray) -> np.ndarray:
    """Words, bytes outside words, mean word length, and repeated words, each as a small number."""
    out = np.zeros((len(w), 4), np.float32)
    for i in range(len(w)):
        a, b = w.at[i], w.at[i + 1]
        n, inside = b - a, int((w.end[a:b] - w.start[a:b]).sum())
        out[i] = (np.log1p(n) / 8, 1 - inside / max(1, sizes[i]), inside / max(1, n) / 10, 1 - len(np.unique(w.hashes[a:b])) / max(1, n))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3e-4, steps: int = 250) -> np.ndarray:
    """Weights, bias last, by accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # The largest curvature by power iteration.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= max(1e-12, np.linalg.norm(v))
    rate = 1 / (0.25 * np.linalg.norm(x @ v) ** 2 / len(x) * 1.1 + ridge)
    w = u = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        g = x.T @ (_sigmoid(x @ u) - y) / len(x)
        g[:-1] += ridge * u[:-1]
        new = u - rate * g.astype(np.float32)
        u = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(np.where(np.append(p[order][1:] < p[order][:-1], True), f1, 0)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def train(sets: list[tuple[np.ndarray, np.ndarray]], form: np.ndarray, y: np.ndarray, categories: list[str], fold: np.ndarray, markers: int = MARKERS) -> dict:
    """Fit the chain on (hashes, counts) of each text, its form, and a column of y a category."""
    every = np.concatenate([s[0] for s in sets])
    doc = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    names, place, seen = np.unique(every, return_inverse=True, return_counts=True)
    strength = np.zeros(len(names))
    for j in range(y.shape[1]):
        rate = y[:, j].mean()
        with_it = np.bincount(place, y[doc, j], len(names))
        expected = seen * rate
        strength = np.maximum(strength, (with_it - expected) ** 2 / np.maximum(expected * (1 - rate), 1e-9) * (seen >= 4))
    chosen = np.sort(names[np.argsort(-strength, kind="stable")[:markers]][:markers])
    x = np.zeros((len(sets), len(chosen)), np.float32)
    for i, (h, c) in enumerate(sets):
        at = np.searchsorted(chosen, h)
        ok = chosen[np.minimum(at, len(chosen) - 1)] == h
        x[i, at[ok]] = np.log1p(c[ok])
    x = np.hstack([x, form])
    model = {"markers": chosen, "categories": categories, "weights": [], "thresholds": []}
    chain = x
    for j in range(y.shape[1]):
        out_of_fold = np.zeros(len(x), np.float32)
        for f in range(FOLDS):
            held = fold == f
            if held.any() and (~held).any():
                w = _logistic(chain[~held], y[~held, j])
                out_of_fold[held] = _sigmoid(chain[held] @ w[:-1] + w[-1])
        model["weights"].append(_logistic(chain, y[:, j]))
        model["thresholds"].append(max(_best_threshold(out_of_fold, y[:, j]), float(y[:, j].mean())) if 0 < y[:, j].sum() < len(y) else 1.1)
        chain = np.hstack([chain, out_of_fold[:, None]])
    return model


def probabilities(model: dict | None, values: list[bytes]) -> np.ndarray:
    """A row for each text, a column for each category."""
    if model is None:
        return np.zeros((len(values), 0))
    names, out = model["markers"], np.zeros((len(values), len(model["weights"])))
    maybe = np.zeros(1 << 16, bool)
    maybe[names & np.uint32(0xFFFF)] = True
    for w in tokens.chunks(values, tokens.ALPHA, fold=True):
        h = _hashes(w)
        row, col = np.nonzero(maybe[h & np.uint32(0xFFFF)])
        at = np.searchsorted(names, h[row, col])
        ok = names[np.minimum(at, len(names) - 1)] == h[row, col]
        doc = np.searchsorted(w.at, row[ok], side="right") - 1
        sizes = np.array([len(v) for v in values[w.first : w.first + len(w)]])
        x = np.log1p(np.bincount(doc * len(names) + at[ok], minlength=len(w) * len(names)).reshape(len(w), -1)).astype(np.float32)
        chain = np.hstack([x, _form(w, sizes)])
        for j, weights in enumerate(model["weights"]):
            p = _sigmoid(chain @ weights[:-1] + weights[-1])
            p[np.diff(w.at) == 0] = 0
            out[w.first : w.first + len(w), j] = p
            chain = np.hstack([chain, p[:, None].astype(np.float32)])
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", rows: int = ROWS, markers: int = MARKERS) -> dict | None:
    """Fit on at most ``rows`` labelled texts.  categories: name to a boolean column of ``labels``, in chain order."""
    name = F.xxhash64(F.col(key).cast("string"))
    k = len(categories)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"y{j}") for j, c in enumerate(categories.values())])
    n = known.count()
    if not n:
        return None
    # Some more keys than are needed, as not all have a text; at most twice as many, those that hash lowest.
    bound = min(1 << 30, int((1 << 30) * rows * 1.1 / n) + 1)
    low = F.pmod(F.xxhash64(F.col("__key").cast("string")), F.lit(1 << 30))
    few = known.where(low < bound).orderBy(low, "__key").limit(rows * 2)
    whole = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__doc"), F.pmod(name, F.lit(1 << 30)).alias("place"), F.col(text).cast("binary").alias("text"))
    found = whole.join(F.broadcast(few), F.col("__doc") == F.col("__key")).select(F.xxhash64("text", "place").alias("of"), "place", *[f"y{j}" for j in range(k)], "text")

    def sets(batches):
        held = tokens.Lowest(rows, HELD)
        for b in batches:
            first = [c.to_pylist() for c in b.columns[: k + 2]]
            values = tokens.texts(b.column(k + 2))
            for w in tokens.chunks(values, tokens.ALPHA, fold=True):
                h, form = _hashes(w), _form(w, np.array([len(v) for v in values[w.first : w.first + len(w)]]))
                for i in range(len(w)):
                    head = tuple(c[w.first + i] for c in first)
                    if held.takes(head):
                        u, c = np.unique(h[w.at[i] : w.at[i + 1]], return_counts=True)
                        held.add(head, (u.tobytes() + zlib.compress(c.astype(np.uint32).tobytes(), 1), np.int64(len(u)).tobytes() + form[i].tobytes()))
        rows_held = [(*head, *parts) for head, parts in held.items()]
        if held.barrier is not None:  # where the sample ends at the latest
            rows_held.append((*held.barrier, None, None))
        types = [pa.int64(), pa.int64(), *[pa.int32()] * k, pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows_held], t) for j, t in enumerate(types)], [*names, "packed", "form"])

    names = ["of", "place", *(f"y{j}" for j in range(k))]
    schema = "of long, place long, " + "".join(f"y{j} int, " for j in range(k)) + "packed binary, form binary"
    # Each task has cut its rows already; the tasks' rows are cut once more by rank before they come here.
    ranked = found.mapInArrow(sets, schema).orderBy("of", "place").limit(rows)
    got, size = [], 0
    for r in ranked.toLocalIterator():
        r = tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)
        if r[k + 2] is None or (got and size + len(r[k + 2]) + len(r[k + 3]) > HELD):
            break
        size += len(r[k + 2]) + len(r[k + 3])
        got.append(r[1:])
    if not got:
        return None
    unpacked = []
    for r in got:
        m = int(np.frombuffer(r[k + 2], np.int64, 1)[0])
        unpacked.append((np.frombuffer(r[k + 1], np.uint32, m), np.frombuffer(zlib.decompress(r[k + 1][4 * m :]), np.uint32)))
    y = np.array([r[1 : k + 1] for r in got], np.float32)
    form = np.frombuffer(b"".join(r[k + 2][8:] for r in got), np.float32).reshape(len(got), -1)
    return train(unpacked, form, y, list(categories), np.array([r[0] % FOLDS for r in got]), markers)


def score(docs: DataFrame, model: dict | None, categories: list[str], text: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """``keep`` with p_<category> and is_<category> of every whole text."""
    chosen = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    names = [f"p_{c}" for c in categories] + [f"is_{c}" for c in categories]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]] + [f"p_{c} double" for c in categories] + [f"is_{c} boolean" for c in categories])

    def run(batches):
        for b in batches:
            p = probabilities(model, tokens.texts(b.column(b.num_columns - 1)))
            p = p if p.shape[1] else np.zeros((b.num_rows, len(categories)))
            least = model["thresholds"] if model else [2.0] * len(categories)
            made = [pa.array(p[:, j]) for j in range(len(categories))] + [pa.array((p[:, j] > 0) & (p[:, j] >= least[j])) for j in range(len(categories))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], *names])

    return chosen.mapInArrow(run, schema)


def clean(docs: DataFrame, model: dict | None, category: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not flagged in ``category``, with all their columns."""
    if model is None:
        return docs
    j = model["categories"].index(category)

    def run(batches):
        for b in batches:
            p = probabilities(model, tokens.texts(b.column(b.num_columns - 1)))[:, j]
            kept = pa.array(~((p > 0) & (p >= model["thresholds"][j])))
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in b.columns[:-1]], b.schema.names[:-1])

    return docs.withColumn(tokens.free_name(docs.columns), F.col(text).cast("binary")).mapInArrow(run, docs.schema)


#: In chain order: what the ``labels`` table has.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def fit_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict | None:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels, {k: F.expr(v) for k, v in CATEGORIES.items()})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit_documents(spark, docs, sf_dir), list(CATEGORIES))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
