"""Alignment of two tokenizers: groups of tokens between shared cuts, linked token pairs and their counts.

Tokenizer A (tokenizers library, byte-level BPE) gets a space and the text, tokenizer B (sentencepiece,
which adds that space itself) the text, both without special tokens: the strings of these are plain text.
Every token covers bytes of space + text. Byte offsets where a token of A and one of B both end are cuts.

1. Cuts are found by divide and conquer: in a stretch of tokens a common end near the middle is located
   (ends of A, from the middle outwards, are bisected in the ends of B), and both halves go on in the
   same way, without the ends that were looked at. A stretch with no cut inside is a leaf: a group. All
   stretches of a block of documents are halved at once; every end of A is looked at once.
2. Tokens whose bytes overlap are linked; a group of m and n tokens has m + n - 1 links. Blocks of
   documents (about BLOCK bytes) keep their links as numbers into the sorted table of their id pairs.
3. The pair tables are summed over the corpus; the count of a pair is in how many links it is, and a
   pair is best if no pair of its B id has more. Every block gets the counts of its own pairs back.

Both libraries are called on distinct stretches only: texts are cut before a single space between two
visible characters (ASCII or Latin-1 letters), where A's splitting has a boundary, and which no piece
of B spans, as none has a space behind another character. A worker remembers a bounded number of them.

NULL and empty texts, and those whose token bytes differ from space + text (as where the text holds
U+2581, which B takes for a space), have no tokens: zeros and an empty ``groups_sha256``. Rows that
repeat, also with one id, are rows of the result each and count each; a NULL id stays NULL. Ties for the
best pair are all best. A very long text is one block, handled by one task (about 200 bytes of memory for
each of its bytes). An empty table gives no rows. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, plain, saved
from .gather import gathered, offsets, written
from .tokens import Encoder

BLOCK = 1 << 20  # bytes of text whose links share a pair table
_B = 1 << 20  # a pair is the id of B times this, plus the id of A


def byte_level() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable bytes for themselves, the
    others, in order, for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each of the ends ``a`` is also one of ``b``. ``first``: where in ``a`` each document begins (n+1).

    Both ascend. The last end of a document is always shared.
    """
    cut = np.zeros(len(a), bool)
    full = first[:-1] < first[1:]
    cut[first[1:][full] - 1] = True
    lo, hi = first[:-1][full], first[1:][full] - 1  # ends not looked at yet
    while len(lo):
        some = lo < hi
        lo, hi = lo[some], hi[some]
        mid, found = (lo + hi) // 2, np.full(len(lo), -1)
        left, right = mid.copy(), mid.copy()  # looked at: left <= k < right
        open_, step = np.arange(len(lo)), 0
        while len(open_):
            # by turns one to the right and one to the left, as long as there are any
            go_right = (right[open_] < hi[open_]) & ((step % 2 == 0) | (left[open_] == lo[open_]))
            at = np.where(go_right, right[open_], left[open_] - 1)
            right[open_] += go_right
            left[open_] -= ~go_right
            met = b[np.minimum(np.searchsorted(b, a[at]), len(b) - 1)] == a[at]
            found[open_[met]] = at[met]
            open_ = open_[~met]
            open_ = open_[(left[open_] > lo[open_]) | (right[open_] < hi[open_])]
            step += 1
        met = found >= 0
        cut[found[met]] = True
        lo, hi = np.concatenate([lo[met], right[met]]), np.concatenate([left[met], hi[met]])
    return cut


class Pair:
    """Ids of both tokenizers for stretches of text that begin with a space; remembers at most about ``keep`` of them."""

    def __init__(self, a_path: str, b_path: str, keep: int = 400_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.rows = Encoder(a_path)
        byte = byte_level()
        size = self.a.get_vocab_size()
        tokens = [self.a.id_to_token(k) or "" for k in range(size)]
        own = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
        other = [self._piece(k) for k in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (own, other))
        self.a_bytes, self.b_bytes = (np.frombuffer(b"".join(t), np.uint8) for t in (own, other))
        self.keep = keep
        self._forget()

    def _piece(self, k: int) -> bytes:
        return bytes([int(self.b.id_to_piece(k)[1:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()

    def _forget(self) -> None:
        """``seen`` numbers the stretches; ids of stretch k are pool[at[k] : at[k + 1]]."""
        self.seen: dict[bytes, int] = {}
        self.good = np.zeros(0, bool)
        self.pools, self.ats = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def _encode(self, stretches: list[bytes]) -> None:
        texts = [s.decode() for s in stretches]
        # the quick way takes the special token for a separator; stretches that hold it go one by one
        plain_ = [not self.rows.mark or self.rows.mark not in t for t in texts]
        quick = iter(self.rows._merge([t for t, p in zip(texts, plain_) if p]))
        mine = [next(quick) if p else np.array(self.a.encode(t, add_special_tokens=False).ids, np.int32) for t, p in zip(texts, plain_)]
        other = self.b.encode([t[1:] for t in texts], num_threads=1)
        raw, length = np.frombuffer(b"".join(stretches), np.uint8), np.array([len(s) for s in stretches], np.int64)
        good = np.ones(len(texts), bool)
        for k, (ids, size, data) in enumerate(((np.concatenate(mine), self.a_size, self.a_bytes), (np.fromiter(chain.from_iterable(other), np.int64), self.b_size, self.b_bytes))):
            at = offsets(np.array([len(x) for x in (mine, other)[k]], np.int64))
            good &= _spells(ids, at, size, data, raw, length)
            self.pools[k] = np.concatenate([self.pools[k], ids.astype(np.int32)])
            self.ats[k] = np.concatenate([self.ats[k], self.ats[k][-1] + at[1:]])
        self.good = np.concatenate([self.good, good])
        self.seen.update(zip(stretches, range(len(self.seen), len(self.seen) + len(stretches))))

    def ids(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, their rows' offsets, ids of B, their rows' offsets).

        raw, ends: rows that begin with a space each. Rows whose bytes do not come out have no ids.
        """
        starts = _stretches(raw, ends)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        distinct, which = column.dictionary.to_pylist(), column.indices.to_numpy()
        if len(self.seen) > self.keep:
            self._forget()
        new = [s for s in distinct if s not in self.seen]
        if new:
            self._encode(new)
        which = np.fromiter(map(self.seen.__getitem__, distinct), np.int64, len(distinct))[which]
        first = np.searchsorted(starts, ends)
        bad = offsets(~self.good[which])
        whole = bad[first[1:]] == bad[first[:-1]]
        which, first = which[np.repeat(whole, np.diff(first))], offsets(np.diff(first) * whole)
        (a, at_a), (b, at_b) = (gathered(pool, at, which) for pool, at in zip(self.pools, self.ats))
        return a, at_a[first], b, at_b[first]


def _spells(ids: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the token bytes of each stretch are its own. data, size: bytes of all tokens; raw, length: of the stretches."""
    spelt = np.diff(offsets(size[ids])[at])
    same = spelt == length
    mine = gathered(data, offsets(size), ids[np.repeat(same, np.diff(at))])[0]
    differ = offsets(mine != raw[np.repeat(same, length)])
    stop = np.cumsum(length[same])
    same[same] = differ[stop] == differ[stop - length[same]]
    return same


def _stretches(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of rows, and places of single spaces between visible ASCII characters or two-byte Latin letters."""
    shown = (raw > 0x20) & (raw < 0x7F)
    after = np.append(shown | (raw == 0xC3), False)[1:]
    before = np.concatenate([[False], shown[:-1]]) if len(raw) else shown
    before[2:] |= raw[:-2] == 0xC3
    cut = (raw == 0x20) & after & before
    cut[ends[:-1][ends[1:] > ends[:-1]]] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str) -> Pair:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each Spark task
    return Pair(a_path, b_path)


def _spaced(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row with a space before it; empty rows stay empty."""
    full = np.diff(ends) > 0
    return np.insert(raw, ends[:-1][full], 0x20), ends + np.concatenate([[0], np.cumsum(full)])


class Aligned:
    """The alignment of a block of rows (space + text each).

    a, b: ids; first_a, first_b: rows' offsets in them; end_a, end_b: byte ends; cut_a, cut_b: whether a group ends.
    """

    def __init__(self, pair: Pair, raw: np.ndarray, ends: np.ndarray):
        self.a, self.first_a, self.b, self.first_b = pair.ids(raw, ends)
        self.end_a, self.end_b = np.cumsum(pair.a_size[self.a]), np.cumsum(pair.b_size[self.b])
        self.cut_a = shared_cuts(self.end_a, self.end_b, self.first_a)
        self.cut_b = np.zeros(len(self.b), bool)
        self.cut_b[np.searchsorted(self.end_b, self.end_a[self.cut_a])] = True
        self.n_groups = np.diff(np.concatenate([[0], np.cumsum(self.cut_a)])[self.first_a])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number in ``a`` and in ``b`` of every linked pair, in the order of bytes, and the rows' offsets."""
        # every end of either closes one overlap; a shared end closes one
        order = np.argsort(np.concatenate([self.end_a, self.end_b[~self.cut_b]]), kind="stable")  # two ascending runs
        of_a = order < len(self.a)
        of_b = ~of_a
        of_b[of_a] = self.cut_a
        at = offsets(np.diff(self.first_a) + np.diff(self.first_b) - self.n_groups)
        return np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b, at

    def digests(self) -> list[str]:
        """SHA-256 of each row's groups ``a1,a2|b1;a3|b2,b3``; '' for a row without tokens."""
        group_a = np.cumsum(self.cut_a) - self.cut_a
        group_b = np.cumsum(self.cut_b) - self.cut_b
        n = int(self.cut_a.sum())
        upto_a, upto_b = np.searchsorted(group_a, np.arange(n + 1)), np.searchsorted(group_b, np.arange(n + 1))
        at_a = np.arange(len(self.a)) + upto_b[group_a]
        at_b = np.arange(len(self.b)) + upto_a[group_b + 1]
        ids, before = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        before[:] = ord(",")
        before[at_a[upto_a[:-1]]], before[at_b[upto_b[:-1]]] = ord(";"), ord("|")
        row = self.first_a + self.first_b
        before[row[:-1][row[1:] > row[:-1]]] = 0
        text, size = written(ids, before)
        data, at = text.tobytes(), np.concatenate([[0], np.cumsum(size)])[row]
        return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


_ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.binary()), ("times", pa.binary())])
_ROWS_SQL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs binary, times binary"


def _blocks(batches, a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """Rows of documents with their links as numbers into the pair table of the block, which its first row holds."""
    from pyspark import TaskContext

    pair, block = _pair(a_path, b_path), TaskContext.get().partitionId() << 32
    for batch, raw, ends in parts(batches, BLOCK):
        own = Aligned(pair, *_spaced(raw, ends))
        a, b, at = own.links()
        pairs, number, times = np.unique(own.b[b].astype(np.int64) * _B + own.a[a], return_inverse=True, return_counts=True)
        data, at4, n = number.astype("<i4").tobytes(), (4 * at).tolist(), len(batch)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, block)), batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (np.diff(own.first_a), np.diff(own.first_b), own.n_groups, np.diff(at))),
                pa.array(own.digests(), pa.string()), pa.array([data[x:y] for x, y in zip(at4[:-1], at4[1:])], pa.binary()),
                *(pa.array([x.astype("<i8").tobytes(), *[None] * (n - 1)], pa.binary()) for x in (pairs, times)),
            ],
            schema=_ROWS,
        )
        block += 1


def _listed(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, times in zip(batch.column("block").to_pylist(), batch.column("pairs"), batch.column("times")):
            pairs, times = (np.frombuffer(x.as_buffer(), "<i8") for x in (pairs, times))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(times)], names=["block", "pair", "times"])


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in the corpus, and whether no pair of its B id has more.

    A B id has at most as many pairs as A has ids.
    """
    counts = listed.groupBy("pair").agg(F.sum("times").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 20)))
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def _scored(key, docs: pa.Table, counts: pa.Table) -> pa.Table:
    counts = counts.sort_by("pair")
    count, best = counts.column("count").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    links = [np.frombuffer(x, "<i4") for x in docs.column("links").to_pylist()]
    best_of, sum_of = [int(best[x].sum()) for x in links], [int(count[x].sum()) for x in links]
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(best_of, pa.int64())).append_column("count_sum", pa.array(sum_of, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = saved(plain(docs, "doc_id", "text").mapInArrow(lambda b: _blocks(b, a_path, b_path), _ROWS_SQL), "aligned")
    listed = rows.filter("pairs is not null").select("block", "pairs", "times").mapInArrow(_listed, "block long, pair long, times long")
    scored = saved(listed.select("block", "pair").join(pair_counts(listed), "pair"), "pair-counts")
    each = rows.drop("pairs", "times").groupBy("block").cogroup(scored.groupBy("block"))
    return each.applyInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def groups(texts: list[str | None], a_path: str, b_path: str) -> list[list[tuple[list[int], list[int]]]]:
    """The groups of some texts, as lists of (ids of A, ids of B)."""
    raw = [b" " + t.encode() if t else b"" for t in texts]
    own = Aligned(_pair(a_path, b_path), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    out = []
    for k in range(len(texts)):
        a, b = slice(*own.first_a[k : k + 2]), slice(*own.first_b[k : k + 2])
        cuts = [np.flatnonzero(c) + 1 for c in (own.cut_a[a], own.cut_b[b])]
        lists = [np.split(ids, c[:-1]) if len(ids) else [] for ids, c in zip((own.a[a], own.b[b]), cuts)]
        out.append([(x.tolist(), y.tolist()) for x, y in zip(*lists)])
    return out
