"""Byte-level BPE against the public library, and its round trip."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from tankline.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def odd_texts():
    rnd = random.Random(5)
    texts = [
        None, "", " ", "\n", "a" * 3000, "ab" * 700, "x" * 97, "it's  don't   \n\n  stop 1234567890", "漢字かな交じり文を書く" * 40, "สวัสดีครับ",
        "   hello\u0085x y​z", "\U00031350\U0002EBF0 \U0001FAE8 ࡰࡱ Ᲊ", " <|endoftext|> ", "\x00\x01 \x7f", "é é",
    ]
    some = ["a", "b", "e", "n", "th", "ing", "é", "ñ", "漢", "字", "の", " ", "ß", "́", "ж", "к", "ष", "1", "."]
    texts += ["".join(rnd.choice(some[: rnd.randint(2, len(some))]) for _ in range(n)) for n in (5, 30, 150, 700, 3000) for _ in range(8)]
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x4E00, 0x9000, 7)]
    texts += ["".join(rnd.choice(letters) for _ in range(800)) for _ in range(8)]
    return texts + ["".join(chr(rnd.choice([rnd.randrange(1, 0xD800), rnd.randrange(0xE000, 0x32000)])) for _ in range(200)) for _ in range(20)]


@pytest.mark.parametrize("block", [1, 1 << 24])  # a block for each document, or one for all of a batch
def test_ids_are_those_of_the_library(spark, library, monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "BLOCK", block)
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert [i for i, x in enumerate(texts) if got[i] != library.encode_ordinary(x or "")] == []


def test_round_trip():
    ranks = byte_bpe.read_ranks(PATH)
    texts = [t.encode() for t in odd_texts() if t]
    ids = [[ranks[bytes([b])] for b in t] for t in texts]
    raw, _ = byte_bpe.decoder(ranks)(np.concatenate([np.array(x) for x in ids]))
    assert raw.tobytes() == b"".join(texts)


def test_digests_null_empty_repeated_and_other_columns(spark, library):
    rows = [(1, None, 5), (2, "", 5), (None, "a tie a tie", 1), (3, "a tie", None), (3, "a tie", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").selectExpr("*", "1 as word", "2 as slot")
    got = byte_bpe.token_digests(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    out = byte_bpe.token_digests(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_each_distinct_word_is_folded_once(spark):
    """The fold stands behind the aggregate of the words, below the join that takes ids back."""
    docs = spark.createDataFrame([(k, "a b a b") for k in range(50)], SCHEMA).repartition(4)
    words = byte_bpe.word_ids(docs, byte_bpe.RankMap(byte_bpe.read_ranks(PATH)), public_tokenizers.PATTERN)[1]
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [word") == 1 and "Python" not in plan.split("Aggregate [word")[0]
    assert {tuple(r.ids) for r in words.collect()} == {(r,) for r in {byte_bpe.read_ranks(PATH)[w] for w in (b"a", b" a", b" b")}}


def test_texts_are_cut_once_and_one_exchange_deals_documents_and_words(spark):
    docs = spark.createDataFrame([(k, f"a b c{k} d") for k in range(50)], SCHEMA).repartition(4)
    out = byte_bpe.token_digests(docs, PATH, public_tokenizers.PATTERN)
    assert len(out.collect()) == 50
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("regexp_extract_all") == 1 and plan.count("ReusedExchange") == 1


@pytest.mark.parametrize("stretch", [1, 1 << 18])
def test_blocks_are_put_together_by_stretches(spark, library, monkeypatch, stretch):
    monkeypatch.setattr(byte_bpe, "STRETCH", stretch)
    texts = ["", "a tie", None, "", "to be or not to be " * 30, " ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1)
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {i: library.encode_ordinary(x or "") for i, x in enumerate(texts)}


def test_ids_of_words_are_packed_by_block():
    rows = [(of, number, [of % 11 + number, 65535][: 1 + number % 2]) for of in (3, 1 << 33) for number in (2, 0, 1)]
    kinds = {"of": pa.int64(), "number": pa.int32(), "ids": pa.list_(pa.int32())}
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
    (packets,) = byte_bpe._packets(iter([batch]))
    assert packets.column("of").to_pylist() == [3, 1 << 33]
    for n, of in enumerate((3, 1 << 33)):
        pool, at = byte_bpe._pool(pa.Table.from_batches([packets.slice(n, 1)]))
        assert [pool[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == [ids for o, _, ids in sorted(rows) if o == of]
