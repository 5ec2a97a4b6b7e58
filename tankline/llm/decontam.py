"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are taken in blocks of bounded size. A block's words (runs of letters and digits, in
   lower case) are the terms; how many passages of the corpus hold each is counted over all documents.
2. The TF-IDF matrix of all passages (PASSAGE words each, unit rows) is sketched in one distributed
   pass, sum of A'(A Omega), from which the driver draws its leading right singular vectors.
3. Items longer than the largest window are cut into pieces that are not. Windows of the documents, of
   sizes near each piece's and at steps of STEP words, are projected and compared with the pieces by
   cosine; what reaches ``cosine`` for one piece makes its whole item a candidate.
4. A candidate's words, with a margin, are compared with the item's: the item is held if the longest
   common subsequence has ``copied`` of its words, or, for paraphrases, ``paraphrased`` of them and
   ``answered`` of the answer's, the item's last sentence.
5. Items under ``least`` words are held where all their words stand side by side in their order.

Results: a row for each document and item it holds. A NULL or empty text or item holds nothing and is
held by nothing. Rows are searched one by one, so ids may repeat
or be NULL; items that repeat are reported once each per item_id. Other columns are not looked at. An
empty table on either side gives no rows.

A very long text is searched whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTER, Rolling, mix, parts, plain, slices, text_arrays, words
from .language import folded

PASSAGE, STEP = 32, 6
SIZES = (12, 18, 24, 36, 48, 60, 96)  # words of a window
_WORD = LETTER.copy()
_WORD[48:58] = True


@lru_cache(maxsize=1)
def _hasher() -> Rolling:
    return Rolling(31)


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the first word of each row (n+1)."""
    starts, stops, first = words(raw, ends, _WORD)
    hasher = _hasher()
    hasher.load(folded(raw))
    return hasher.hashes(starts, stops), first


class Terms:
    """Numbers of the terms among word hashes; -1 for other words."""

    def __init__(self, hashes: np.ndarray, bits: int = 18):
        self.shift = np.uint64(64 - bits)
        self.hashes = hashes  # sorted
        spot = (hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(spot, np.arange((1 << bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))

    def number(self, h: np.ndarray) -> np.ndarray:
        spot = (h >> self.shift).astype(np.int64)
        lo, hi = self.first[spot], self.first[spot + 1]
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(lo < hi)
        lo, hi, own = lo[maybe], hi[maybe], h[maybe]
        for k in range(self.deepest):
            at = np.minimum(lo + k, len(self.hashes) - 1)
            hit = (lo + k < hi) & (self.hashes[at] == own)
            out[maybe[hit]] = at[hit]
        return out


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, words and answers, as bytes so that tasks can keep what they build."""

    ids: tuple
    words: tuple[bytes, ...]
    answers: tuple[bytes, ...]
    short: tuple[tuple, ...] = ()  # (id, words) of items under ``least`` words


@lru_cache(maxsize=2)
def _terms(items: Items) -> Terms:
    return Terms(np.unique(np.concatenate([np.frombuffer(w, np.uint64) for w in items.words])))


def read_items(rows: list, least: int) -> Items:
    ids, own, answers, short = [], [], [], []
    for item, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h = word_hashes(raw, np.array([0, len(raw)]))[0]
        if len(h) < least:
            if len(h):
                short.append((item, h.tobytes()))
            continue
        sentences = [s for s in (text or "").replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if any(c.isalnum() for c in s)]
        last = np.frombuffer(sentences[-1].encode(), np.uint8)
        ids.append(item)
        own.append(h.tobytes())
        answers.append(word_hashes(last, np.array([0, len(last)]))[0].tobytes())
    return Items(tuple(ids), tuple(own), tuple(answers), tuple(short))


def _passages(batches, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per piece of a task's texts: (passage, term) pairs once each, and the number of passages."""
    terms = _terms(items)
    for _, raw, ends in parts(batches, 1 << 20):
        h, first = word_hashes(raw, ends)
        count = np.diff(first)
        base = np.concatenate([[0], np.cumsum(-(-count // PASSAGE))])
        row = np.repeat(np.arange(len(count)), count)
        passage = base[row] + (np.arange(len(h)) - first[row]) // PASSAGE
        term = terms.number(h)
        passage, term = passage[term >= 0], term[term >= 0].astype(np.int64)
        yield passage, term, int(base[-1])


def _by_term(term: np.ndarray, width: int) -> np.ndarray:
    return np.argsort(term.astype(np.uint16 if width <= 1 << 16 else np.int32), kind="stable")


def _count(batches, items: Items) -> Iterator[pa.RecordBatch]:
    width = len(_terms(items).hashes)
    total, n = np.zeros(width, np.int64), 0
    for passage, term, some in _passages(batches, items):
        order = _by_term(term, width)  # passages stay in order within a term
        passage, term = passage[order], term[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (passage[1:] != passage[:-1])
        total += np.bincount(term[new], minlength=width)
        n += some
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *total[some].tolist()], pa.int64())], names=["term", "n"])


def _omega(width: int, columns: int) -> np.ndarray:
    return np.random.default_rng(53).standard_normal((width, columns)).astype(np.float32)


CHUNK = 256  # terms in a row of the sketch


def _sketch(batches, items: Items, idf: bytes, columns: int) -> Iterator[pa.RecordBatch]:
    weight = np.frombuffer(idf, np.float32)
    width = len(weight)
    omega, total = _omega(width, columns), np.zeros((width, columns))
    for passage, term, n in _passages(batches, items):
        value = weight[term]
        norm = np.sqrt(np.bincount(passage, weights=value * value, minlength=n)).astype(np.float32)
        value = value / np.maximum(norm[passage], 1e-9)
        for lo in range(0, len(term), 200_000):  # passages are in order; a cut one counts as two
            p, t, v = passage[lo : lo + 200_000], term[lo : lo + 200_000], value[lo : lo + 200_000, None]
            begin = np.flatnonzero(np.diff(p, prepend=-1))
            y = np.add.reduceat(omega[t] * v, begin)
            order = _by_term(t, width)
            own = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(p)))[order]
            t = t[order]
            cut = np.flatnonzero(np.diff(t, prepend=-1))
            total[t[cut]] += np.add.reduceat(y[own] * v[order], cut)
    for k in range(0, width, CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total[k : k + CHUNK].tobytes()], pa.binary())], names=["chunk", "part"])


def _added(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of one chunk's parts; a part at a time."""
    total = None
    for batch in rows:
        for part in batch.column("part"):
            x = np.frombuffer(part.as_buffer(), np.float64)
            total = x.copy() if total is None else total + x
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "part"])


@dataclass(frozen=True)
class Space:
    """Projection of terms, already times their IDF."""

    rows: bytes
    rank: int


def fit_space(docs: DataFrame, items: Items, rank: int, spare: int = 4) -> Space:
    """IDF over all passages and the leading right singular vectors of their TF-IDF matrix."""
    width = len(_terms(items).hashes)
    counted = docs.select("text").mapInArrow(lambda b: _count(b, items), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = np.zeros(width + 1)
    for r in counted.toLocalIterator():  # one row for each term of the block
        held[r.term] = r.n
    idf = np.log((1 + held[-1]) / (1 + held[:-1])).astype(np.float32)
    columns = min(width, rank + spare)
    parts_ = docs.select("text").mapInArrow(lambda b: _sketch(b, items, idf.tobytes(), columns), "chunk long, part binary")
    g = np.zeros((width, columns))
    for r in parts_.groupBy("chunk").applyInArrow(_added, "chunk long, part binary").toLocalIterator():
        x = np.frombuffer(r.part).reshape(-1, columns)
        g[r.chunk : r.chunk + len(x)] = x
    # A'A ~ G (Omega'G)^-1 G': its eigenvectors are the right singular vectors of A
    core = _omega(width, columns).T.astype(np.float64) @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(values.max(initial=0), 1e-30)
    if not keep.any():
        return Space(np.zeros((width, 1), np.float32).tobytes(), 1)
    basis, singular, _ = np.linalg.svd(g @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    # directions that all passages of a language share would hide what a passage is about, so each is
    # divided by its singular value
    basis = (basis / np.maximum(singular, 1e-9 * singular[0]))[:, :rank]
    return Space((basis * idf[:, None]).astype(np.float32).tobytes(), basis.shape[1])


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one integer."""
    place: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := place.get(x):
            both = row & m
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=1)
def _opened(items: Items, space: Space):
    terms = _terms(items)
    project = np.frombuffer(space.rows, np.float32).reshape(-1, space.rank)
    own = [np.frombuffer(w, np.uint64) for w in items.words]
    pieces = [(k, int(x[0]), x) for k, w in enumerate(own) for x in np.array_split(np.arange(len(w)), -(-len(w) // SIZES[-1]))]
    latent = np.stack([project[np.searchsorted(terms.hashes, own[k][x])].sum(0) for k, _, x in pieces])
    latent /= np.maximum(1e-9, np.linalg.norm(latent, axis=1))[:, None]
    size = np.array([min(SIZES, key=lambda s: abs(s - len(x))) for *_, x in pieces])
    whole, ahead = np.array([k for k, *_ in pieces]), np.array([at // STEP for _, at, _ in pieces])  # its item, blocks of it before
    scales = [(s, whole[size == s], ahead[size == s], latent[size == s].T.copy()) for s in SIZES if (size == s).any()]
    answers = [np.frombuffer(a, np.uint64) for a in items.answers]
    used = np.zeros((len(own), len(terms.hashes) + 1), bool)  # the last column, also -1, is for other words
    places, counts = np.zeros(used.shape, np.int32), []  # an item's words by its own numbers
    for k, w in enumerate(own):
        at, times = np.unique(np.searchsorted(terms.hashes, w), return_counts=True)
        used[k, at], places[k, at] = True, np.arange(len(at))
        counts.append(times)
    return terms, project, own, answers, scales, used, places, counts


def _sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on."""
    value = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(value)])
    return value


@lru_cache(maxsize=2)
def _short(items: Items) -> list[tuple[int, np.ndarray, list]]:
    """Of each number of words the hashes of the short items, sorted, and the ids of each."""
    by: dict[int, dict[int, list]] = {}
    for item, own in items.short:
        w = np.frombuffer(own, np.uint64)
        by.setdefault(len(w), {}).setdefault(int(_sequences(w, len(w))[0]), []).append(item)
    return [(n, np.array(sorted(x), np.uint64), [x[k] for k in sorted(x)]) for n, x in by.items()]


def held_short(h: np.ndarray, first: np.ndarray, items: Items) -> list[tuple]:
    """What ``held_items`` gives, for the short items."""
    out: set[tuple] = set()
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n, hashes, ids in _short(items):
        value = _sequences(h, n)
        at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
        hit = np.flatnonzero((hashes[at] == value) & (row[: len(value)] == row[n - 1 :][: len(value)]))
        out |= {(int(r), item, 1.0, 1.0, True) for r, k in set(zip(row[hit].tolist(), at[hit].tolist())) for item in ids[k]}
    return list(out)


@dataclass(frozen=True)
class Limits:
    cosine: float = 0.6
    copied: float = 0.7
    paraphrased: float = 0.6
    answered: float = 0.75


def held_items(raw: np.ndarray, ends: np.ndarray, items: Items, space: Space, limits: Limits) -> list[tuple]:
    """(row, item id, cosine, share of the subsequence, answer held) for the items that rows hold, by row."""
    h, first = word_hashes(raw, ends)
    out = held_short(h, first, items)
    if not items.ids:
        return out
    terms, project, own, answers, scales, used, places, counts = _opened(items, space)
    term = terms.number(h)
    count = np.diff(first)
    # blocks of STEP words, rows apart from each other
    blocks = -(-count // STEP)
    base = np.concatenate([[0], np.cumsum(blocks)])
    row = np.repeat(np.arange(len(count)), count)
    block = base[row] + (np.arange(len(h)) - first[row]) // STEP
    sums = np.zeros((int(base[-1]) + 1, space.rank))
    known = np.flatnonzero(term >= 0)
    if len(known):
        begin = np.flatnonzero(np.diff(block[known], prepend=-1))
        sums[block[known[begin]] + 1] = np.add.reduceat(project[term[known]], begin)
        np.cumsum(sums, axis=0, out=sums)
    owner = np.repeat(np.arange(len(count)), blocks)
    hits: list[np.ndarray] = [np.zeros((3, 0))]  # row and item, first block, cosine
    for size, which, ahead, latent in scales:
        n = size // STEP
        start = np.arange(int(base[-1]))
        stop = np.minimum(start + n, base[owner + 1]) if len(start) else start
        # a window that the end of its text cuts short adds nothing unless it is the first
        keep = (start + n <= stop) | (start == base[owner] if len(start) else start)
        start, stop = start[keep], stop[keep]
        for lo in range(0, len(start), 50_000):
            a, b = start[lo : lo + 50_000], stop[lo : lo + 50_000]
            v = (sums[b] - sums[a]).astype(np.float32)
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            near = v @ latent
            w, i = np.nonzero(near >= limits.cosine * np.maximum(norm, 1e-6)[:, None])
            hits.append(np.stack([owner[a[w]] * len(own) + which[i], a[w] - ahead[i], near[w, i] / norm[w]]))
    key, at, near = np.concatenate(hits, axis=1)
    order = np.lexsort((at, key))
    key, at, near = key[order].astype(np.int64), at[order].astype(np.int64), near[order]
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    top = np.maximum.reduceat(near, cut) if len(cut) else near
    for lo_at, hi_at, c in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], top.tolist()):
        r, i = divmod(int(key[lo_at]), len(own))
        item, found = own[i], (0, False)
        reach = 2 * len(item) + 2 * STEP
        for lo, hi in _joined(((at[lo_at:hi_at] - base[r]) * STEP).tolist(), reach):
            lo, hi = first[r] + max(0, lo - len(item) // 2 - STEP), min(first[r + 1], first[r] + hi + reach)
            # only words of the item can be in a common subsequence
            inside = used[i][term[lo:hi]]
            if np.count_nonzero(inside) < limits.paraphrased * len(item):
                continue
            number = places[i][term[lo:hi][inside]]
            # no subsequence is longer than the words in common, each as often as in both
            if np.minimum(np.bincount(number, minlength=len(counts[i])), counts[i]).sum() < limits.paraphrased * len(item):
                continue
            text = h[lo:hi][inside]
            shared = lcs(item, text)
            if shared >= limits.paraphrased * len(item):
                found = max(found, (shared, lcs(answers[i], text) >= limits.answered * len(answers[i])))
        if found[0] >= limits.copied * len(item) or (found[0] >= limits.paraphrased * len(item) and found[1]):
            out.append((r, items.ids[i], c, found[0] / len(item), found[1]))
    return out


_HELD = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())]))


def items_of(text: Column, items: Items, space: Space, limits: Limits) -> Column:
    """Array of what each text holds of a block of items."""

    @F.arrow_udf("array<struct<item_id:bigint,cosine:double,lcs:double,answer:boolean>>")
    def udf(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in arrays:
            raw, ends = text_arrays(column)
            out: list[list] = [[] for _ in range(len(column))]
            for lo, hi in slices(ends, 1 << 20):
                for r, *found in held_items(raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], items, space, limits):
                    out[lo + r].append(dict(zip(("item_id", "cosine", "lcs", "answer"), found)))
            yield pa.array(out, _HELD)

    return udf(F.coalesce(text, F.lit("")))


def _joined(starts: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Ranges of window starts that are near each other, none much longer than ``reach``."""
    lo = hi = starts[0]
    for s in starts[1:]:
        if s - lo > reach:
            yield lo, hi
            lo = s
        hi = s
    yield lo, hi


def searches(docs: DataFrame, benchmark: DataFrame, *, rank: int = 40, least: int = 8, block: int = 1000, limits: Limits = Limits()) -> Iterator[Column]:
    """For each block of items a column that tells what ``text`` holds of it, fitted on ``docs``.

    ``block``: items searched at once; more are searched block after block.
    """
    rows = plain(docs, "text")

    def search(some: list) -> Iterator[Column]:
        own = read_items(some, least)
        if own.ids or own.short:
            space = fit_space(rows, own, rank) if own.ids else Space(b"", 1)
            yield items_of(F.col("text"), own, space, limits)

    items: list = []
    for r in plain(benchmark, "item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        items.append((r.item_id, r.text))
        if len(items) == block:
            yield from search(items)
            items = []
    yield from search(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): the items (item_id, text) that documents hold."""
    rows = plain(docs, "doc_id", "text")
    found = [rows.select("doc_id", F.explode(held).alias("i")).select("doc_id", "i.*") for held in searches(docs, benchmark, **options)]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer boolean")
    # rows, or items, that repeat an id give it once
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))
