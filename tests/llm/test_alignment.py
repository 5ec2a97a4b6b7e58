"""Alignment of two tokenizers against a plain version on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tankline.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_tokens():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = alignment.byte_level()

    def tokens(text):
        if not text:
            return [], []
        mine = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (mine, other) if b"".join(x for _, x in mine) == whole == b"".join(x for _, x in other) else ([], [])

    return tokens


def ranges(tokens):
    ends = np.cumsum([0, *(len(x) for _, x in tokens)]).tolist()
    return [(i, lo, hi) for (i, _), lo, hi in zip(tokens, ends[:-1], ends[1:])]


def brute(texts, tokens):
    """Groups of each text by a walk over its bytes, links by comparing all ranges."""
    groups, links = [], []
    for text in texts:
        a, b = map(ranges, tokens(text))
        cuts = sorted({hi for *_, hi in a} & {hi for *_, hi in b})
        own, lo = [], 0
        for cut in cuts:
            own.append(([i for i, s, e in a if lo < e <= cut], [i for i, s, e in b if lo < e <= cut]))
            lo = cut
        groups.append(own)
        links.append([(i, j) for i, s, e in a for j, t, f in b if s < f and t < e])
    count = Counter(x for own in links for x in own)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for own, linked in zip(groups, links):
        said = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in own)
        out.append((sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(linked), sum(count[x] == most[x[1]] for x in linked), sum(count[x] for x in linked), hashlib.sha256(said.encode()).hexdigest() if own else ""))
    return groups, out


def odd_texts():
    rnd = random.Random(3)
    texts = [None, "", " ", "\n", "a", "  two  spaces ", "word<|endoftext|> <s> </s> <unk> <0x0A> x", "U+2581 ▁ here", "naïve façade × ÷ Ãé ñandú", "漢字かな交じり文 を書く", "é  x​y", "1234 567,89 don't we'll", "a\tb\r\nc", "\x00\x01"]
    some = ["a", "b", "the", "ing", "é", "ñ", "漢", "字", " ", " ", "ß", "ж", "1", ".", ",", "'", "\n", "😀"]
    return texts + ["".join(rnd.choice(some[: rnd.randint(2, len(some))]) for _ in range(n)) for n in (5, 30, 200) for _ in range(15)]


def rows_of(df):
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((str(r.doc_id), *(r[c] for c in cols)) for r in df.collect())


def test_equals_brute_force(spark, plain_tokens, monkeypatch):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted((str(k), *r) for k, r in enumerate(brute(texts, plain_tokens)[1]))
    assert rows_of(alignment.align(docs, A, B)) == want


def test_groups_of_texts(plain_tokens):
    texts = odd_texts()
    assert alignment.groups(texts, A, B) == brute(texts, plain_tokens)[0]


def test_long_text_without_spaces(plain_tokens):
    texts = ["漢字かな交じり文ж" * 400, "x" * 5000]
    assert alignment.groups(texts, A, B) == brute(texts, plain_tokens)[0]


def test_cuts_by_halves():
    """Against the plain intersection, with cuts anywhere."""
    rnd = np.random.default_rng(2)
    for _ in range(200):
        sizes = rnd.integers(0, 30, 5)
        a, b, first, at = [], [], [0], 0
        for n in sizes:
            spots = np.arange(at + 1, at + 1 + max(n, 1))
            if n:
                a += [*spots[rnd.random(n) < rnd.random()][:-1].tolist(), int(spots[-1])]
                b += [*spots[rnd.random(n) < rnd.random()][:-1].tolist(), int(spots[-1])]
            a, b = sorted(set(a)), sorted(set(b))
            first.append(len(a))
            at = int(spots[-1])
        got = alignment.shared_cuts(np.array(a, np.int64), np.array(b, np.int64), np.array(first))
        assert got.tolist() == [x in set(b) for x in a]


def test_null_id_repeats_and_other_columns(spark, plain_tokens):
    texts = ["one two", "one two", None, "one"]
    docs = spark.createDataFrame([(1, texts[0], 3), (1, texts[1], 3), (None, texts[2], 4), (None, texts[3], None)], "doc_id long, text string, block int").selectExpr("*", "1 as pair", "'x' as links")
    want = sorted((str(d), *r) for d, r in zip((1, 1, None, None), brute(texts, plain_tokens)[1]))
    assert rows_of(alignment.align(docs, A, B)) == want


def test_empty_table(spark):
    out = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.columns[0] == "doc_id" and out.count() == 0
