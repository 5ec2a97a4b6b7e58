"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACES = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, cls int, drop string, marks int"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def lines_kept(texts: list, min_docs: int = 10) -> list:
    """(n_lines, n_dropped, text) of each text."""
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    split = [(t or "").split("\n") for t in texts]
    count = Counter(k for ls in split for k in {key(x) for x in ls} if k)
    out = []
    for ls in split:
        keep = [x for x in ls if count[key(x)] < min_docs]
        out.append((len(ls), len(ls) - len(keep), "\n".join(keep)))
    return out


def shingles(text) -> set:
    w = [x for x in SPACES.split(lower(text or "")) if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(docs: list) -> dict:
    """Least id reachable of each id; docs are (id, text)."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(i), find(sets[j][0])))
                root[b] = a
        for g in s:
            holders[g].append(k)
    return {i: find(i) for i in root}


def cut_repeats(texts: list, window: int = 200) -> list:
    """(n_removed, n_spans, kept bytes) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + window] for b in raw for k in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out
