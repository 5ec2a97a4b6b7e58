"""Toxicity by a classifier chain.

The categories are label columns, predicted one after the other: each category's linear model sees the
text and the probabilities of the categories before it. In fitting, those probabilities come from
models of other folds (out of fold), so a later model learns from what it will meet. By default the
chain is low quality, then toxic, as these are the labels that ``labels`` has.

A text's features are whether it holds a word of letters or a beginning of one (5 to 8 bytes), the
``features`` most telling ones by chi-square over the sample. Fitting uses a bounded sample of about
``per_class`` labelled rows of each combination of labels. Every text is scored whole.

NULL and empty texts have no features and get the base rates. A category without both classes in its
sample has probability 0. Every row is scored by itself, so ids may repeat or be NULL (a row without id
has no labels); a row labelled twice counts twice, one with a NULL label not at all; other columns are not looked at; empty tables give
no rows.

A very long text is scored whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER, Rolling, bounded_sample, parts, plain, slices, text_arrays, words
from .language import folded

PREFIXES = (5, 6, 7, 8)
_BITS = 20  # features are numbered by so many bits of their hash


@lru_cache(maxsize=1)
def _hasher() -> Rolling:
    return Rolling(11)


def feature_ids(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature number) of all words and their beginnings, with repetitions."""
    starts, stops, first = words(raw, ends, LETTER)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    hasher = _hasher()
    hasher.load(folded(raw))
    shift = np.uint64(64 - _BITS)
    yield row, (hasher.hashes(starts, stops) >> shift).astype(np.int64)
    for n in PREFIXES:
        long = stops - starts > n
        salt = np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        yield row[long], ((hasher.hashes(starts[long], starts[long] + n) ^ salt) >> shift).astype(np.int64)


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    features: bytes  # int64 numbers
    weights: tuple[bytes, ...]  # per category: float64 features + earlier categories + base


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 150) -> np.ndarray:
    """Weights (last: base) of a regularised logistic regression, by accelerated gradient steps.

    Both classes weigh the same.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    penalty = np.full(x.shape[1], l2, np.float32)
    penalty[-1] = 0
    w = np.zeros(x.shape[1], np.float32)
    ahead, rate = w.copy(), 4 / (1e-6 + float((x**2).sum(1) @ weight))
    for k in range(steps):
        grad = x.T @ (weight * (_probability(x @ ahead) - y).astype(np.float32)) + penalty * ahead
        new = ahead - rate * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w.astype(np.float64)


def _held_features(batches) -> Iterator[pa.RecordBatch]:
    for batch, raw, ends in parts(batches, 1 << 20):
        both = list(feature_ids(raw, ends))
        row, ids = (np.concatenate([x[k] for x in both]) for k in (0, 1))
        pair = np.unique(row << _BITS | ids)
        cut = np.searchsorted(pair >> _BITS, np.arange(len(batch) + 1))
        ids = (pair & ((1 << _BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["key", "features"])


def fit(docs: DataFrame, labels: DataFrame, *, chain: tuple[str, ...] = ("low_quality", "toxic"), per_class: int = 2500, features: int = 1500, folds: int = 3, l2: float = 1e-4) -> Chain | None:
    """Fit on documents joined with ``labels`` (doc_id and a 0/1 column for each category; ``low_quality``
    is read from ``quality``). Categories without a column are left out of the chain, and rows in which
    a label is NULL out of the fit. None if nothing is labelled, or no category has a column."""
    source = {c: "quality" if c == "low_quality" else c for c in chain}
    chain = tuple(c for c in chain if source[c] in labels.columns)
    if not chain:
        return None
    given = [F.col(source[c]).cast("int") for c in chain]
    known = labels.select(F.col("doc_id").cast("long"), *(((x == 0) if c == "low_quality" else (x != 0)).cast("int").alias(f"label_{k}") for k, (c, x) in enumerate(zip(chain, given))))
    known = known.dropna().select("doc_id", F.concat_ws("", *(f"label_{k}" for k in range(len(chain)))).alias("key"))
    some = bounded_sample(known, "key", per_class)  # at most twice per_class of each combination, so it may be broadcast
    texts = plain(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").select("key", "text")
    # an id that very many documents share brings no more rows than this
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("text"), "text"))
    texts = texts.withColumn("place", place).filter(F.col("place") <= 4 * per_class).select("key", "text")
    rows = sorted(texts.mapInArrow(_held_features, "key string, features binary").toLocalIterator(), key=lambda r: (r.key, bytes(r.features)))
    if not rows:
        return None
    held = [np.frombuffer(r.features, np.int32) for r in rows]
    label = np.array([[int(c) for c in r.key] for r in rows])
    row, ids = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held)
    total = np.bincount(ids, minlength=1 << _BITS)
    telling = np.zeros(0, np.int64)
    for c in range(len(chain)):
        share = label[:, c].mean()
        got = np.bincount(ids, weights=label[row, c], minlength=1 << _BITS)
        chi = (got - total * share) ** 2 / np.maximum(1, total * max(share * (1 - share), 1e-9))
        chi[total < 3] = 0
        telling = np.union1d(telling, np.argsort(-chi, kind="stable")[: features // len(chain)])
    place = np.full(1 << _BITS, -1)
    place[telling] = np.arange(len(telling))
    x = np.zeros((len(held), len(telling)), np.float32)
    at = place[ids]
    x[row[at >= 0], at[at >= 0]] = 1
    part = np.arange(len(held)) % folds
    weights, earlier = [], np.zeros((len(held), 0), np.float32)
    for c in range(len(chain)):
        y, full = label[:, c], np.concatenate([x, earlier], axis=1)
        if y.min() == y.max():
            w, out = np.append(np.zeros(full.shape[1]), -30.0), np.zeros(len(held))
        else:
            w, out = _logistic(full, y, l2), np.zeros(len(held))
            for f in range(folds):  # what later models see comes from models that have not seen the row
                other = _logistic(full[part != f], y[part != f], l2)
                out[part == f] = _probability(full[part == f] @ other[:-1] + other[-1])
        weights.append(w.tobytes())
        earlier = np.concatenate([earlier, out[:, None].astype(np.float32)], axis=1)
    return Chain(tuple(chain), telling.astype(np.int64).tobytes(), tuple(weights))


@lru_cache(maxsize=1)
def _opened(model: Chain) -> np.ndarray:
    place = np.full(1 << _BITS, -1, np.int32)
    ids = np.frombuffer(model.features, np.int64)
    place[ids] = np.arange(len(ids), dtype=np.int32)
    return place


def probabilities(model: Chain, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows x categories."""
    place, n = _opened(model), len(ends) - 1
    width = len(model.features) // 8
    own = []
    for row, ids in feature_ids(raw, ends):
        at = place[ids]
        own.append(np.unique(row[at >= 0] * width + at[at >= 0]))
    pair = np.unique(np.concatenate(own))
    row, at = pair // max(1, width), pair % max(1, width)
    out = np.zeros((n, len(model.categories)))
    for c, data in enumerate(model.weights):
        w = np.frombuffer(data)
        out[:, c] = _probability(np.bincount(row, weights=w[at], minlength=n) + out[:, :c] @ w[width : width + c] + w[-1])
    return out


def _score(arrays: Iterator[pa.Array], model: Chain) -> Iterator[pa.Array]:
    for column in arrays:
        raw, ends = text_arrays(column)
        done = [np.zeros((0, len(model.categories)))]
        for lo, hi in slices(ends, 1 << 20):
            done.append(probabilities(model, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]))
        both = np.concatenate(done)
        yield pa.StructArray.from_arrays([pa.array(both[:, c]) for c in range(both.shape[1])], list(model.categories))


def toxicity_of(text: Column, model: Chain) -> Column:
    """Struct with a probability for each category."""

    @F.arrow_udf(", ".join(f"{c} double" for c in model.categories))
    def udf(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _score(arrays, model)

    return udf(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """Per row: doc_id, a probability for each category (p_<category>), and toxic (p_toxic >= threshold)."""
    model, rows = fit(docs, labels, **options), plain(docs, "doc_id", "text")
    chain = options.get("chain", ("low_quality", "toxic"))
    if model is None:
        return rows.select("doc_id", *(F.lit(0.0).alias(f"p_{c}") for c in chain), F.lit(False).alias("toxic"))
    out = rows.select("doc_id", toxicity_of(F.col("text"), model).alias("p"))
    return out.select("doc_id", *(F.col("p")[c].alias(f"p_{c}") for c in chain), (F.col("p")["toxic"] >= threshold).alias("toxic"))
