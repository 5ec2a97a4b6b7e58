"""Ragged arrays: stretches of a pool gathered, and numbers written as text, without a loop over them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def offsets(sizes: np.ndarray) -> np.ndarray:
    """n+1 offsets of stretches of these sizes."""
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def gathered(pool: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches pool[at[w] : at[w + 1]] for w in ``which``, one after the other, and their n+1 offsets."""
    size = np.diff(at)[which]
    total = offsets(size)
    return pool[np.repeat(at[which] - total[:-1], size) + np.arange(total[-1])], total


@lru_cache(maxsize=1)
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below 10**5, right-justified, behind a free byte, and which of them are shown."""
    n = np.arange(10**5)
    digits, show = np.zeros((len(n), 6), np.uint8), np.zeros((len(n), 6), bool)
    for k in range(5):
        power = 10 ** (4 - k)
        digits[:, k + 1] = 48 + n // power % 10
        show[:, k + 1] = (n >= power) | (power == 1)
    return digits, show


def written(ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids (below 10**5), each behind its separator (0: none), as bytes, and the number of bytes of each."""
    digits, show = (t[ids] for t in _decimals())
    digits[:, 0], show[:, 0] = before, before > 0
    return digits[show], show.sum(1)
