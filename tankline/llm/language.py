"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (n = 1..3, letters in lower case) that both
hold, whatever their counts, over the root of the product of their own numbers: the blended-spectrum
presence kernel. Landmark texts give a Nystroem map, on which ridge regression is fitted one language
against the rest. Texts are scored in blocks: presence matrix x landmarks x weights.

Fitting uses a bounded sample: about ``per_language`` texts of each language, of which ``landmarks``
are landmarks, over the ``grams`` most common n-grams of the sample. Every text is scored whole.

Results: a text that is NULL or has no letter is ``und`` with score 0. Without any labelled text all
are ``und``. Ties between languages go to the first by name. Every row is scored by itself, so ids may
repeat or be NULL, and columns other than those named are not looked at. An empty table gives no rows.

A very long text is scored whole, in blocks of its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_sample, give_back, parts, plain, slices, text_arrays

UNKNOWN = "und"
#: numbers of all 1-, 2- and 3-grams side by side
_BASE = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}
_ALL = (1 << 8) + (1 << 16) + (1 << 24)


def folded(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    low = LOWER[raw]
    if len(low) > 1:
        after = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][after] += 0x20
    return low


def grams(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For n = 1, 2, 3 the number of the n-gram that starts at each byte."""
    code = folded(raw).astype(np.int32)
    one = code
    yield 1, code
    for n in (2, 3):
        code = (code[:-1] << 8) | one[n - 1 :]
        yield n, code + _BASE[n]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: bytes  # n-gram numbers, int32
    landmarks: bytes  # bits, grams x landmarks
    count: int
    weights: bytes  # float32, landmarks x languages


@lru_cache(maxsize=1)
def _opened(model: Model):
    codes = np.frombuffer(model.codes, np.int32)
    table = np.full(_ALL, -1, np.int16)
    table[codes] = np.arange(len(codes), dtype=np.int16)
    bits = np.unpackbits(np.frombuffer(model.landmarks, np.uint8), count=len(codes) * model.count)
    marks = bits.reshape(len(codes), model.count).astype(np.float32)
    marks /= np.maximum(1, np.sqrt(marks.sum(0)))
    return table, marks, np.frombuffer(model.weights, np.float32).reshape(model.count, -1), len(codes)


def presence(raw: np.ndarray, ends: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """0/1 matrix of rows x n-grams."""
    flags = np.zeros((len(ends) - 1, width + 1), np.uint8)  # the last column takes n-grams not asked for
    if len(raw):
        size = np.diff(ends)
        base = np.repeat(np.arange(len(size), dtype=np.int32) * (width + 1), size)
        flat = flags.reshape(-1)
        for n, code in grams(raw):
            at = table[code]
            if n > 1:  # n-grams do not run from one row into the next
                for back in range(1, n):
                    over = ends[1:-1] - back
                    at[over[(over >= 0) & (over < len(at))]] = -1
            spot = base[: len(at)] + at
            flat[spot[at >= 0]] = 1
    return flags[:, :width]


def scores(model: Model, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    table, marks, weights, width = _opened(model)
    have = presence(raw, ends, table, width).astype(np.float32)
    return ((have @ marks) / np.maximum(1, np.sqrt(have.sum(1)))[:, None]) @ weights


def _held_grams(batches) -> Iterator[pa.RecordBatch]:
    """The distinct n-gram numbers of each text, for fitting."""
    for batch, raw, ends in parts(batches, 1 << 20):
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            out.append(np.concatenate([np.unique(c) for _, c in grams(raw[a:b])] or [np.zeros(0, np.int32)]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.binary())], names=["lang", "grams"])


def fit(labelled: DataFrame, *, per_language: int = 400, landmarks: int = 128, grams: int = 6000, ridge: float = 1e-3) -> Model | None:
    """Model from labelled texts (doc_id, text, lang); None where there are none.

    Every language is learned, from about ``per_language`` texts, and has a landmark: there are
    ``landmarks`` of them, or as many as languages if these are more.
    """
    sample = bounded_sample(plain(labelled, "doc_id", "text", "lang").filter("lang is not null and text is not null"), "lang", per_language)
    rows = sorted(sample.mapInArrow(_held_grams, "lang string, grams binary").toLocalIterator(), key=lambda r: (r.lang, bytes(r.grams)))
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    texts = [np.frombuffer(r.grams, np.int32) for r in rows]
    found, counts = np.unique(np.concatenate(texts), return_counts=True)
    codes = np.sort(found[np.argsort(-counts, kind="stable")[:grams]])
    have = np.zeros((len(texts), len(codes)), np.float32)
    for k, t in enumerate(texts):
        have[k, np.isin(codes, t, assume_unique=True)] = 1
    own = np.array([languages.index(r.lang) for r in rows])
    # landmarks: from each language in turn
    shuffled = np.random.default_rng(5).permutation(len(rows))
    turn = np.zeros(len(rows), np.int64)
    for c in range(len(languages)):
        mine = shuffled[own[shuffled] == c]
        turn[mine] = np.arange(len(mine))
    chosen = np.argsort(turn, kind="stable")[: max(landmarks, len(languages))]
    marks = have[chosen]
    unit = lambda m: m / np.maximum(1, np.sqrt(m.sum(1)))[:, None]
    kernel = unit(have) @ unit(marks).T
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    mapped = kernel @ root
    target = np.eye(len(languages))[own]
    balance = np.sqrt(len(rows) / (len(languages) * np.maximum(1, np.bincount(own, minlength=len(languages)))))[own][:, None]
    a, b = mapped * balance, target * balance
    solved = np.linalg.solve(a.T @ a + ridge * len(rows) * np.eye(len(chosen)), a.T @ b)
    weights = (root @ solved).astype(np.float32)
    return Model(tuple(languages), codes.astype(np.int32).tobytes(), np.packbits(marks.T.astype(np.uint8)).tobytes(), len(chosen), weights.tobytes())


def _predict(arrays: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    names = np.array(model.languages, object)
    for column in arrays:
        raw, ends = text_arrays(column)
        best, top = np.zeros(len(column), np.int64), np.zeros(len(column))
        for lo, hi in slices(ends, 1 << 20):
            for a in range(lo, hi, 256):
                b = min(hi, a + 256)
                s = scores(model, raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                best[a:b], top[a:b] = s.argmax(1), np.clip(s.max(1), 0, 1)
        yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(top, pa.float64())], ["lang", "score"])
    give_back()


def language_of(text: Column, model: Model | None) -> Column:
    """Struct (lang, score) of a text column."""
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return nothing

    @F.arrow_udf("lang string, score double")
    def udf(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _predict(arrays, model)

    # the model sees every text; those without a letter are then set aside
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), udf(F.coalesce(text, F.lit("")))).otherwise(nothing)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    rows = plain(docs, "doc_id", "text")
    out = rows.select("doc_id", language_of(F.col("text"), model).alias("p"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def learn_and_predict(docs: DataFrame) -> DataFrame:
    """Fit on the three folds that are not held out, predict every row."""
    return predict(docs, fit(docs.filter(fold(F.col("doc_id")) != 2)))
