"""Token ids with a public tokenizer: whole texts in, ids out.

Texts are cut into pieces at places where the tokenizer's own splitting always has a boundary: before
a single space between two visible characters, and between a letter and ``. , ; : ! ?``. No part of
its pattern runs over either, so the ids of the pieces, joined, are the ids of the text. The cut is
made only next to ASCII and Latin-1 letters (bytes C3 xx), where bytes tell what a character is;
other scripts stay in longer pieces. Pieces repeat, so each worker keeps a bounded memory of those it
has seen, compared by their full bytes, and the library merges only new ones.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import as_strided

from .common import mix

# byte classes: 1 visible ASCII, 2 ASCII letter, 4 lead byte C3, 8 one of .,;:!?, 16 the space
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] |= 1
_CLASS[0x41:0x5B] |= 2
_CLASS[0x61:0x7B] |= 2
_CLASS[0xC3] |= 4
_CLASS[[ord(c) for c in ".,;:!?"]] |= 8
_CLASS[0x20] |= 16

_LANES = 4  # pieces of up to 32 bytes are remembered
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def piece_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First byte of every piece; rows always begin one (unless empty)."""
    n = len(raw)
    kind = np.zeros(n + 3, np.uint8)
    kind[2:-1] = _CLASS[raw]
    here, before, lead, after = kind[2:-1], kind[1:-2], kind[:-3], kind[3:]
    latin = (lead & 4) != 0
    cut = ((here & 16) != 0) & (((before & 1) != 0) | latin) & ((after & 5) != 0)
    # C3 97 and C3 B7 are signs, not letters
    prior = np.zeros(n, np.uint8)
    prior[1:] = raw[:-1]
    cut |= ((here & 8) != 0) & (((before & 2) != 0) | (latin & (prior != 0x97) & (prior != 0xB7)))
    full = ends[:-1][ends[1:] > ends[:-1]]
    cut[full] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts. Remembers at most ``keep`` pieces and then forgets them all."""

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip)]
        self.mark, self.mark_id = special[0] if special else ("", -1)
        self.keep = keep
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.lanes = np.zeros((_LANES, 0), np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def _merge(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece. A call for one short piece costs more than its merges, so pieces go in
        long rows with a special token between them, which the library cuts out first."""
        out: list[np.ndarray] = []
        for lo in range(0, len(pieces), 500):
            some = pieces[lo : lo + 500]
            if not self.mark or any(self.mark in p for p in some):
                out += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            else:
                ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, self.kind)
                at = np.flatnonzero(ids == self.mark_id)
                starts, stops = [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]
                out += [ids[a:b] for a, b in zip(starts, stops, strict=True)]
        return out

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the n+1 offsets of the rows."""
        starts = piece_starts(raw, ends)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(ends), np.int64)
        if len(self.keys) > self.keep:
            self._forget()
        stops = np.append(starts[1:], len(raw))
        size = stops - starts
        padded = np.concatenate([raw, np.zeros(8 * _LANES, np.uint8)])
        view = as_strided(padded.view(np.uint8)[: 8 * (len(padded) // 8)].view(np.uint64), (len(padded) - 7,), (1,))
        lanes = np.empty((_LANES, len(starts)), np.uint64)
        key = size.astype(np.uint64)
        for k in range(_LANES):
            have = np.clip(size - 8 * k, 0, 8)
            lanes[k] = view[np.where(have > 0, starts + 8 * k, 0)] & _MASK[have]
            key = key * _MULT[k] ^ mix(lanes[k])
        key = mix(key)
        # pieces too long for the lanes are told apart by their place and never remembered
        long = size > 8 * _LANES
        key[long] = mix(starts[long].astype(np.uint64) ^ np.uint64(1 << 62))
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        if (lanes != lanes[:, first[back]])[:, ~long].any() or (size != size[first[back]]).any():
            raise ValueError("two pieces of one batch share a key")
        entry = np.zeros(len(distinct), np.int64)
        if len(self.keys):
            entry = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            known = (self.keys[entry] == distinct) & (self.lanes[:, entry] == lanes[:, first]).all(0) & ~long[first]
        else:
            known = np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        at, length, pool = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), self.pool
        if len(self.keys):
            at[known], length[known] = self.at[entry[known]], self.size[entry[known]]
        if len(new):
            data = raw.tobytes()
            pieces = [data[a:b].decode() for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist())]
            got = self._merge(pieces)
            length[new] = [len(g) for g in got]
            at[new] = len(pool) + np.cumsum(length[new]) - length[new]
            pool = np.concatenate([pool, *got])
            stay = new[~long[first[new]]]
            if len(stay):
                self.pool = pool
                place = np.searchsorted(self.keys, distinct[stay])
                self.keys = np.insert(self.keys, place, distinct[stay])
                self.lanes = np.insert(self.lanes, place, lanes[:, first[stay]], axis=1)
                self.at, self.size = np.insert(self.at, place, at[stay]), np.insert(self.size, place, length[stay])
        size, at = length[back], at[back]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, ends)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each Spark task
    return Encoder(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
