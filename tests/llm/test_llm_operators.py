"""Operators against brute force, round trips, SQL and held-out labels on the small given tables."""

import os
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from brute import cut_repeats, groups, lines_kept, shingles  # noqa: E402
from compare import connect, differences  # noqa: E402

import corpus_pipeline  # noqa: E402
from tankline.llm import decontam, licenses, near_dup, packing, queries, suffix_dedup, token_files  # noqa: E402
from tankline.llm.common import text_arrays  # noqa: E402
from tankline.llm.graph import components  # noqa: E402
from tankline.llm.tokens import Encoder, vocabulary  # noqa: E402

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def tokenizer():
    return Encoder(vocabulary("byte_bpe_50k.json")).tokenizer


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, D), con, queries.ORACLES[name]) is None


def test_pieces_join_to_the_same_ids(tokenizer):
    enc, rng = Encoder(vocabulary("byte_bpe_50k.json"), keep=500), random.Random(3)
    some = ["a", "é", " ", "  ", "\n", ".", ",", "'s", "'", "12", "日", "\xa0", "×", "the", "!", "<|endoftext|>", "\r\n", "\u0085", "word"]
    for _ in range(60):
        texts = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(20)]
        ids, at = enc.encode(*text_arrays(pa.array(texts)))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, docs, tokenizer):
    want, start = {}, 0
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op3_token_files"](spark, D).collect()} == want


def test_records_in_any_order_and_damage(spark, tmp_path):
    table = spark.createDataFrame([(k, f"text number {k} " * k) for k in range(20)] + [(None, None)], "doc_id long, text string")
    folder = str(tmp_path / "out")
    shards = [r.shard for r in token_files.write_records(table.coalesce(1), folder, vocab=vocabulary("byte_bpe_50k.json")).collect()]
    rows = {}
    for s in shards:
        whole = list(token_files.read_records(folder, s, 2))
        order = list(range(len(whole)))[::-1]
        for k, (i, ids) in zip(order, token_files.read_records(folder, s, 2, order)):
            assert whole[k][0] == i and (whole[k][1] == ids).all()
        rows.update({i: len(x) for i, x in whole})
    assert set(rows) == {None, *range(20)} and rows[None] == 1
    path = f"{folder}/tokens-{shards[-1]:06d}.bin"
    data = bytearray(Path(path).read_bytes())
    data[-6] ^= 1
    Path(path).write_bytes(data)
    with pytest.raises(ValueError):
        list(token_files.read_records(folder, shards[-1], 2))


def packed_right(rows, want, capacity=1024):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[i])
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) <= capacity
    return len(bins)


def test_packing(spark, docs, tokenizer):
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs}
    n = packed_right(queries.QUERIES["op10_best_fit_packing"](spark, D).collect(), want)
    assert n <= 1.03 * sum(map(len, want.values())) / 1024 + 1


def test_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1025, 3000)
    bins = packing.best_fit(lengths, 1024)
    assert sorted(k for b in bins for k in b) == list(range(3000))
    assert max(lengths[b].sum() for b in bins) <= 1024
    assert packing.best_fit(np.array([600, 500, 424, 524]), 1024) == [[0, 2], [3, 1]]


def test_many_rounds_of_packing(spark):
    table = spark.createDataFrame([(k, "word " * (k % 50 + 1)) for k in range(400)], "doc_id long, text string").repartition(40)
    rows = packing.pack_documents(table, fan_in=2, task_bins=5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))


def test_suffix_dedup(spark, docs):
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(queries.documents(spark, D)).collect()}
    assert got == {i: x for (i, _), x in zip(docs, cut_repeats([t for _, t in docs]))}


def test_suffix_dedup_over_several_shards(spark, monkeypatch):
    """Common passages with different surroundings, anchors dealt to several shards and merged."""
    monkeypatch.setattr(suffix_dedup, "SHARD", 4)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = ["".join(rng.choice("xyz ") for _ in range(rng.randrange(300))) + passage[rng.randrange(40) :] + rng.choice("pq") * rng.randrange(300) for _ in range(60)]
    texts += ["ab" * 400, "ab" * 90, passage * 3]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table).collect()}
    assert got == dict(enumerate(cut_repeats(texts)))


def test_suffix_dedup_beside_runs_over_several_shards(spark, monkeypatch):
    """Unique text beside runs: a window holds its anchor's string at several places, and is no repeat of itself."""
    monkeypatch.setattr(suffix_dedup, "SHARD", 4)
    rng = random.Random(15)
    own = lambda: "".join(rng.choice("abcdefghijkl ") for _ in range(rng.randrange(220, 400)))
    signs = [chr(c) for c in range(33, 127)]
    at = np.arange(len(signs)) * suffix_dedup.GRAM
    hasher = suffix_dedup._hashers()[0]
    hasher.load(np.repeat(np.array([ord(c) for c in signs], np.uint8), suffix_dedup.GRAM))
    sign = signs[int(np.argmin(hasher.hashes(at, at + suffix_dedup.GRAM)))]  # its run is the anchor of most windows that hold it
    texts = [own() + sign * rng.randrange(64, 191) + own() for _ in range(90)]
    texts += [texts[0], texts[70][:500]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table).collect()}
    assert got == dict(enumerate(cut_repeats(texts)))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(20):
        text = np.concatenate([rng.integers(97, 99, 300, dtype=np.uint8), np.zeros(32, np.uint8)])
        sa, new = suffix_dedup.suffix_array(text, 32)
        raw = text.tobytes()
        assert [raw[k : k + 32] for k in sa if k < 300] == sorted(raw[k : k + 32] for k in range(300))
        own, lcp = suffix_dedup.common_prefixes(text, sa, new, np.array([0, 150]), np.array([130, 290]), 16)
        assert own.tolist() == [k for k in sa if k < 130 or 150 <= k < 290]
        for a, b, n in zip(own[:-1], own[1:], lcp[1:]):
            same = next((k for k in range(16) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1]), 16)
            assert n == same


def test_near_duplicates(spark, docs):
    root = groups(docs)
    for r in near_dup.near_duplicates(queries.documents(spark, D)).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(docs[r.doc_id][1])), root[r.doc_id], r.doc_id == root[r.doc_id])


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Families with more members than a task takes, and chains of them."""
    monkeypatch.setattr(near_dup, "CHUNK", 20)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(70):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [" ".join(rng.choice(words) for _ in range(100)) for _ in range(30)] + texts[:40]
    rows = list(enumerate(texts))
    root = groups(rows)
    for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.component_id == root[r.doc_id]


def test_links_among_many_alike(spark, monkeypatch):
    """Documents of one template at 0.62 to 0.73, which are not linked, with pairs at 0.75 to 0.8 and chains."""
    monkeypatch.setattr(near_dup, "CHUNK", 60)
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base, docs = fresh(130), []
    for _ in range(1000):
        docs.append((fresh(n := rng.randrange(12, 18)), fresh(30 - n)))
    for _ in range(150):  # a pair with a few words more in common
        docs.append(own := (fresh(15), fresh(15)))
        docs.append((fresh(15), own[1][: rng.randrange(9, 13)] + fresh(4)))
    for _ in range(6):  # chains: each document is linked to the one before and the one after it only
        left, right = fresh(15), fresh(15)
        for k in range(12):
            docs.append((left, right))
            left, right = (left, right[:10] + fresh(5)) if k % 2 else (fresh(5) + left[5:], right)
            left, right = (fresh(15), right) if k % 2 == 0 else (left, fresh(15))
    rng.shuffle(docs)
    rows = [(k, " ".join(a + base + b)) for k, (a, b) in enumerate(docs)]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {k: find(k) for k in range(len(rows))}
    assert sum(want[k] != k for k in want) >= 200
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[k] != want[k] for k in want) == 0


def test_two_classes_that_share_many_keys_meet_in_one_block():
    """Of the keys that two classes have in common only the first one answers for them."""
    import pandas as pd

    keys = np.arange(4 * near_dup.BANDS, dtype=np.int64).reshape(4, -1)
    keys[:3, 2] = keys[:3, 9] = 1 << 40  # three agree in two bands
    keys[:3, 9] += 1
    keys[3, 9] = keys[0, 9]  # the last one only in the later band
    sketch = np.zeros(near_dup.BITS // 64, np.uint64).tobytes()

    def block(own: list[int], key: int) -> pd.DataFrame:
        return pd.DataFrame({"cls": own, "sketch": sketch, "keys": [keys[k].tobytes() for k in own], "known": own, "key": key, "i": 0, "j": 0, "share": 0})

    found = [near_dup._unsure(block(own, int(key))) for own, key in (([0, 1, 2], keys[0, 2]), ([0, 1, 2, 3], keys[0, 9]))]
    assert [sorted(zip(f["a"], f["b"])) for f in found] == [[(0, 1), (0, 2), (1, 2)], [(0, 3), (1, 3), (2, 3)]]
    own = np.arange(50, dtype=np.uint64).tobytes()
    links = [near_dup._linked(block(own_ids, int(key)).assign(own=own)) for own_ids, key in (([0, 1, 2], keys[0, 2]), ([0, 1, 2], keys[0, 9]))]
    assert [len(x) for x in links] == [2, 0]


def test_sketch_estimates():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(60):
            both = rng.integers(1, 1 << 63, 800, dtype=np.uint64)
            n = round(800 * share)
            rest = (800 - n) // 2
            a, b = both[: n + rest], np.concatenate([both[:n], both[n + rest :]])
            s = near_dup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            x, y = near_dup.odd_sketches(s)
            errors.append(near_dup.estimate(np.bitwise_count(x ^ y).sum()) - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 50)] + [(100, 101), (101, 100), (103, 102), (7, 7)] + [(200, 200 + k) for k in range(1, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 102: 102, 103: 102, **{200 + k: 200 for k in range(40)}}


def test_language_on_held_out_rows(spark, con):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in queries.QUERIES["op1_language_id"](spark, D).collect() if r.held_out]
    assert rows and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_toxicity_of_words_held_out(spark):
    from tankline.llm import toxicity

    rng = random.Random(8)
    plain_words = ["tree", "house", "river", "cloud", "stone", "bread", "light", "green"]
    bad = ["scumbag", "moronic", "vermin"]
    rows = []
    for k in range(400):
        own = [rng.choice(plain_words) for _ in range(30)]
        if k % 4 == 0:
            own[rng.randrange(30)] = rng.choice(bad) + rng.choice(["", "s", "ly"])
        rows.append((k, " ".join(own), int(k % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in rows if k % 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.classify(docs, labels).collect()}
    assert sum(got[k] == bool(t) for k, _, t in rows if k % 3 == 0) >= 0.97 * len(rows) / 3


def test_licenses(spark, docs):
    import re

    words = lambda s: re.findall(r"[^\W_]+", s.lower())
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    notice = licenses.TEMPLATES["MIT-notice"].split()
    more = [(1000, "x " * 500 + " ".join(notice[:-4]) + " y" * 300), (1001, " ".join(notice[: len(notice) // 2])), (1002, "All Rights, reserved"), (1003, None)]
    rows = docs + more
    want = set()
    for name, text in licenses.TEMPLATES.items():
        w = words(text)
        k = min(5, len(w))
        own = grams(w, k)
        want |= {(i, name) for i, t in rows if len(grams(words(t or ""), k) & own) >= 0.75 * len(own)}
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and (1000, "MIT-notice") in got


def test_decontamination(spark, con, docs):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    rng = random.Random(6)
    copies = []
    for k, (_, text) in enumerate(items[:10]):  # paraphrases: a word in eight is another
        w = [rng.choice(("zebra", "quartz")) if rng.random() < 0.12 else x for x in text.split()]
        copies.append((5000 + k, " ".join(f"filler{rng.randrange(99)}" for _ in range(60)) + " " + " ".join(w) + " and so on"))
    table = spark.createDataFrame(docs + copies, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    exact = {(i, k) for i, t in docs for k, x in items if x in (t or "")}
    assert exact <= got
    assert sum((5000 + k, items[k][0]) in got for k in range(10)) >= 9
    assert len(got) <= len(exact) + 12


def test_decontamination_of_long_and_short_items(spark, docs):
    """Word-for-word copies of items of 200 to 400 words, and of three to six."""
    rng = random.Random(21)
    known = [w for _, t in docs for w in (t or "").split() if w.isalpha()]
    item = lambda n: " ".join(rng.choice(known) for _ in range(n))
    items = [(k, item(n)) for k, n in enumerate([200, 250, 300, 350, 400] * 4)] + [(100 + k, item(3 + k % 4) + f" unusual{k}") for k in range(12)]
    filler = lambda: item(90)
    rows = [(5000 + k, f"{filler()} {t} {filler()}") for k, t in items]
    table = spark.createDataFrame(docs + rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((5000 + k, k) in got for k, _ in items if k < 100) >= 19
    assert {x for x in got if x[1] >= 100} == {(5000 + k, k) for k, _ in items if k >= 100}


def test_subsequence():
    def slow(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert decontam.lcs(a, b) == slow(a, b)


def test_pipeline(spark, con, docs, tokenizer):
    rows = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    rows = [(i, x[2]) for (i, _), x in zip(rows, lines_kept([t for _, t in rows]))]
    root = groups(rows)
    rows = [(i, t) for i, t in rows if root[i] == i]
    items = [x for (x,) in con.execute("SELECT text FROM benchmark").fetchall()]
    rows = [(i, t) for i, t in rows if not any(x in t for x in items)]
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    packed_right(corpus_pipeline.run(spark, D).collect(), want)


def test_recall_of_paraphrases(spark):
    """Copies with words replaced that the rule accepts, by a search for the subsequence, are found at any share."""
    rnd = random.Random(4)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    pool = [w for r in queries.documents(spark, D).limit(60).collect() for w in (r.text or "").split()]
    hashed = lambda t: decontam.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    docs, want = [], {}
    for share in (0.1, 0.2, 0.25, 0.3, 0.35, 0.4):
        for item, text in bench:
            own = [rnd.choice(pool) if rnd.random() < share else w for w in text.split()]
            around = [rnd.choice(pool) for _ in range(rnd.randrange(200))]
            at = rnd.randrange(len(around) + 1)
            mine = hashed(text)
            if len(mine) >= 8 and decontam.lcs(mine, hashed(" ".join(own))) >= 0.7 * len(mine):
                want.setdefault(share, []).append((len(docs), item))
            docs.append((len(docs), " ".join(around[:at] + own + around[at:])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for share, pairs in want.items():
        assert sum(p in got for p in pairs) >= 0.9 * len(pairs), share


def test_every_language_is_learned(spark):
    """More languages than landmarks."""
    from tankline.llm import language

    rnd = random.Random(2)
    words = {k: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for k in range(150)}
    rows = [(100 * k + n, " ".join(rnd.choice(words[k]) for _ in range(40)), f"l{k:03d}") for k in words for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=3)
    got = docs.select("lang", language.language_of(docs["text"], model).alias("p")).select("lang", "p.lang").collect()
    assert len({r[1] for r in got}) == 150 and sum(r[0] == r[1] for r in got) >= 0.95 * len(got)


def test_null_labels_are_no_labels(spark):
    from tankline.llm import toxicity

    bad, good = "vile nasty words here", "kind gentle words here"
    docs = spark.createDataFrame([(k, bad if k % 2 else good) for k in range(80)], "doc_id long, text string")
    rows = [(k, 1, k % 2) for k in range(40)] + [(k, 1, None) for k in range(40, 80)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    known = toxicity.fit(docs, labels.filter("toxic is not null"))
    assert toxicity.fit(docs, labels) == known
    alone = toxicity.fit(docs, labels.drop("quality"))
    assert alone.categories == ("toxic",)
    assert toxicity.fit(docs, labels.select("doc_id")) is None


def test_whole_licence_texts(spark):
    """Texts of licences inside long documents, with words changed, and none in documents without."""
    rnd = random.Random(6)
    words = [f"word{k}" for k in range(400)]
    around = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows, want = [], {}
    for k, (name, text) in enumerate(t for t in licenses.TEMPLATES.items() if t[0].endswith("-text")):
        own = text.split()
        for at in range(20, len(own), 60):
            own[at] = rnd.choice(words)
        rows += [(2 * k, f"{around(700)} {' '.join(own)} {around(300)}"), (2 * k + 1, around(900))]
        want[2 * k] = name
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r[0], r[1]) for r in got}
    assert all((k, name) in found for k, name in want.items()) and all(k % 2 == 0 for k, _ in found)
