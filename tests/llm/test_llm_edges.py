"""NULLs, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from brute import DOCS, cut_repeats, groups, lines_kept  # noqa: E402

import corpus_pipeline  # noqa: E402
from tankline.llm import decontam, language, licenses, line_dedup, near_dup, packing, quality, suffix_dedup, token_files, toxicity  # noqa: E402

BASE = "The quick brown fox jumps over the lazy dog, and then it sleeps for a while in the warm sun. "
LONG = " ".join(f"word{k}" for k in range(40_000)) + "\n" + BASE
TEXTS = [
    (1, BASE * 3), (1, BASE * 3), (2, None), (3, ""), (4, "   \n\n  "), (5, LONG), (None, BASE), (None, None), (6, BASE * 3),
    (7, "one two"), (8, "One  TWO"), (9, "é" * 300), (10, "été déjà vu"), (10, "another text under the same id"), (11, "1234 !!! ---"),
]
LINES = [(100 + k, f"A line that all share\n  a LINE that all share \nown {k}") for k in range(12)]
OPERATORS = {
    "language": lambda d: language.learn_and_predict(d),
    "lines": lambda d: line_dedup.line_digests(d),
    "tokens": lambda d: token_files.encode_and_read(d),
    "suffixes": lambda d: suffix_dedup.repeat_digests(d),
    "quality": lambda d: quality.line_quality(d),
    "toxicity": lambda d: toxicity.classify(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic", "1 quality").filter("doc_id < 9")),
    "near": lambda d: near_dup.near_duplicates(d),
    "licenses": lambda d: licenses.scan(d),
    "decontam": lambda d: decontam.contaminated(d, d.selectExpr("doc_id as item_id", "text").filter("item_id = 10 or item_id is null")),
    "packing": lambda d: packing.pack_documents(d),
}
PER_ROW = ["language", "lines", "tokens", "suffixes", "quality", "toxicity", "near"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, TEXTS + LINES).repartition(3).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(edge, name):
    rows = OPERATORS[name](edge).collect()
    if name in PER_ROW:
        key = lambda x: (x is None, x or 0)
        assert sorted((r.doc_id for r in rows), key=key) == sorted((i for i, _ in TEXTS + LINES), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages(spark, tmp_path, edge, stage):
    name, fn = corpus_pipeline.STAGES[stage]
    spark.createDataFrame([(1, "another text under the same id that is long enough"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = fn(spark, edge, str(tmp_path))
    if name != "packing":
        assert out.columns == edge.columns
    assert out.count() > 0
    assert fn(spark, table(spark, []), str(tmp_path)).count() == 0


def test_language_of_nothing(edge):
    for r in language.learn_and_predict(edge).collect():
        assert (r.lang_pred, r.score) == ("und", 0.0)  # no row has a language to learn from


def test_unknown_only_without_letters(spark):
    rows = [(k, t, lang) for k in range(40) for t, lang in ((f"the cat and the dog {k}", "en"), (f"le chat et la souris {k}", "fr"))]
    docs = spark.createDataFrame([(i, t, x) for i, (_, t, x) in enumerate(rows)] + [(900, None, "en"), (901, "12 ?!", "fr"), (902, "LE CHAT", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.learn_and_predict(docs).collect()}
    assert got[900] == got[901] == "und" and got[902] == "fr"
    assert all(got[i] == x for i, (_, _, x) in enumerate(rows))


def test_lines(edge):
    want = sorted((i or -1, n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, d, t) in zip(TEXTS + LINES, lines_kept([t for _, t in TEXTS + LINES])))
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(edge).collect()) == want


def test_suffixes(edge):
    want = sorted((i or -1, n, s, hashlib.sha256(b).hexdigest()) for (i, _), (n, s, b) in zip(TEXTS + LINES, cut_repeats([t for _, t in TEXTS + LINES])))
    assert sorted((r.doc_id or -1, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(edge).collect()) == want


def test_near(edge):
    rows = [(i, t) for i, t in TEXTS + LINES if i is not None]
    root = groups(rows)
    for r in near_dup.near_duplicates(edge).collect():
        if r.doc_id is not None:
            assert r.component_id == root[r.doc_id] and r.kept == (r.doc_id == root[r.doc_id])


def test_one_of_each_group(spark, edge):
    kept = corpus_pipeline.near_dedup(spark, edge, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id in (1, 6, 7, 8)) == [1, 7]


def test_clean_line_quality(spark):
    good = " ".join(f"word{k}" for k in range(30)) + "."
    menu = "Home | News | Sport | Weather | About us | Contact"
    got = {r.doc_id: r for r in quality.line_quality(spark.createDataFrame([(1, f"{good}\n{menu}"), (2, f"{menu}\n" * 9 + "A short end."), (3, None)], "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].cleaned == good
    assert not got[2].kept and not got[3].kept and got[3].base_failed
