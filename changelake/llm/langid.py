"""Language identification: family first, then one-versus-one linear SVMs.

A text becomes a vector of hashed letter 1- to 3-gram frequencies.  A first
level of one-versus-one linear SVMs picks the language family; a second level,
trained within each family only, tells its closely related languages apart.

Fitting uses at most ``per_language`` labelled rows of each language, those whose
key and text hash lowest, so a rerun fits the same model; each task cuts to that
bound before anything is sent on, whatever keys repeat.  Prediction is one
pass without a shuffle; the model's size depends on the number of languages
only, never on the data.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows
with a null label are never learned from; repeated rows get equal predictions;
an empty table gives an empty result; with no labelled row at all every text is
``und``; further columns are ignored.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens

DIMS = 2048
#: Language families by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "af": "germanic", "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "be": "slavic", "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "sl": "slavic", "sr": "slavic", "uk": "slavic",
}
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def features(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of hashed letter n-grams; and which texts have a letter."""
    table = _is_letter()
    out = np.zeros((len(values), DIMS), np.float32)
    has = np.zeros(len(values), bool)
    i = 0
    while i < len(values):
        j, n = i, 0
        while j < len(values) and (j == i or n + len(values[j]) <= tokens.CHUNK // 4) and j - i < 256:
            n += len(values[j])
            j += 1
        low = [f" {v.lower()} " for v in values[i:j]]
        c = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
        doc = np.repeat(np.arange(j - i), [len(v) for v in low])
        letter = table[c]
        c = np.where(letter, c, 32).astype(np.uint32)
        has[i:j] = np.bincount(doc[letter], minlength=j - i) > 0
        two = (c[:-1] * np.uint32(0x9E3779B1)) ^ c[1:]
        grams = [(c * np.uint32(0x85EBCA6B), letter, doc), (two * np.uint32(0xC2B2AE35), (letter[:-1] | letter[1:]) & (doc[:-1] == doc[1:]), doc[:-1])]
        three = ((two[:-1] * np.uint32(0x27D4EB2F)) ^ c[2:]) * np.uint32(0x165667B1)
        grams.append((three, (letter[:-2] | letter[1:-1]) & letter[1:-1] & (doc[:-2] == doc[2:]), doc[:-2]))
        count = np.zeros((j - i) * DIMS)
        for h, ok, d in grams:
            count += np.bincount(d[ok] * DIMS + (h[ok] >> np.uint32(21)), minlength=(j - i) * DIMS)
        x = np.sqrt(count.reshape(j - i, DIMS))
        out[i:j] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        i = j
    return out, has


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 120) -> np.ndarray:
    """A linear SVM (squared hinge, L2) by accelerated full-batch descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost / len(y)
    rate = 1 / (1 + 2 * (weight * (x * x).sum(1)).sum())
    w = v = np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * x.T @ (weight * y * slack))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def _one_vs_one(x: np.ndarray, y: np.ndarray) -> dict:
    names = sorted(set(y.tolist()))
    pairs = list(combinations(range(len(names)), 2))
    weights = [_svm(x[m], np.where(y[m] == names[a], 1.0, -1.0)) for a, b in pairs if (m := (y == names[a]) | (y == names[b])).any()]
    return {"names": names, "pairs": pairs, "w": np.array(weights).reshape(len(pairs), x.shape[1] + 1)}


def _choose(level: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class with most votes, ties by summed margins and then by name; and its mean probability."""
    k = len(level["names"])
    if k == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    votes, margins, chance = (np.zeros((len(x), k)) for _ in range(3))
    for (a, b), w in zip(level["pairs"], level["w"], strict=True):
        m = np.clip(x @ w[:-1] + w[-1], -30, 30)
        p = 1 / (1 + np.exp(-2 * m))
        for c, s, q in ((a, m, p), (b, -m, 1 - p)):
            votes[:, c] += s > 0 if c == b else s >= 0
            margins[:, c] += s
            chance[:, c] += q / (k - 1)
    best = np.argmax(votes + 1e-3 * np.tanh(margins / 50), axis=1)
    return best, chance[np.arange(len(x)), best]


def train(x: np.ndarray, lang: list[str], families: dict[str, str] = FAMILIES) -> dict:
    """Fit both levels on feature rows."""
    y = np.array(lang, dtype=object)
    family = np.array([families.get(v, v) for v in lang], dtype=object)
    return {"top": _one_vs_one(x, family), "within": {f: _one_vs_one(x[family == f], y[family == f]) for f in sorted(set(family.tolist()))}}


def predict_rows(model: dict | None, values: list[str | None]) -> tuple[list[str], list[float]]:
    x, has = features([v or "" for v in values])
    lang, score = np.full(len(values), "und", dtype=object), np.zeros(len(values))
    if model is not None and has.any():
        family, p = _choose(model["top"], x)
        for i, name in enumerate(model["top"]["names"]):
            if (at := np.flatnonzero(has & (family == i))).size:
                level = model["within"][name]
                best, q = _choose(level, x[at])
                lang[at] = np.array(level["names"], dtype=object)[best]
                score[at] = np.round(np.clip(p[at] * q, 0, 1), 6)  # the last digits depend on what else is in a batch
    return lang.tolist(), score.tolist()


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", families: dict[str, str] = FAMILIES, per_language: int = 600) -> dict | None:
    """Fit on ``rows``: at most ``per_language`` of each label, those whose key hashes lowest."""
    known = rows.where(F.col(label).isNotNull())
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), text), F.lit(1 << 30))
    # One row a language; the bound on hashes spares most texts the work, and no row that could be among the lowest.
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    if not counts:
        return None
    bound = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1 << 30, int((1 << 30) * per_language * 1.3 / n) + 1))])
    sample = known.where(place < bound[F.col(label)]).select(place.alias("place"), F.xxhash64(text).alias("of"), F.col(label).alias("label"), F.col(text).alias("text"))

    def vectors(batches):
        held: dict[str, tokens.Lowest] = {}
        for b in batches:
            heads = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            labels = b.column(2).to_pylist()
            kept = [i for i, (h, y) in enumerate(zip(heads, labels, strict=True)) if held.setdefault(y, tokens.Lowest(per_language, 1 << 40)).takes(h)]
            texts = b.column(3).take(pa.array(kept, pa.int64())).to_pylist()
            x, has = features([v or "" for v in texts])
            half = x.astype(np.float16)
            for j in np.flatnonzero(has):
                held[labels[kept[j]]].add(heads[kept[j]], (half[j].tobytes(),))
        rows = [(*head, y, x) for y, h in held.items() for head, (x,) in h.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["place", "of", "label", "x"])

    found = sample.mapInArrow(vectors, "place long, of long, label string, x binary")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place", "of"))
    kept = sorted((r[0], r[1], r[2], bytes(r[3])) for r in found.withColumn("rank", rank).where(F.col("rank") <= per_language).select("label", "place", "of", "x").collect())
    if not kept:
        return None
    return train(np.frombuffer(b"".join(r[3] for r in kept), np.float16).reshape(-1, DIMS).astype(np.float32), [r[0] for r in kept], families)


def identify(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and score, for every whole text."""
    chosen = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", lang_pred string, score double"

    def run(batches):
        for b in batches:
            lang, score = predict_rows(model, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return chosen.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = fit(docs.where(~F.coalesce(held, F.lit(False))))
    return identify(docs, model, keep=["doc_id", F.coalesce(held, F.lit(False)).alias("held_out")])


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
