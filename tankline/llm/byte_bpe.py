"""Byte-level BPE encoding and decoding, by a fold of higher-order functions over distinct words.

1. Spark cuts the texts into words, the matches of the splitting pattern. Blocks of documents (about
   BLOCK bytes at most) number their distinct words, and each document keeps the numbers of its words. One
   exchange deals both: documents by block, words by a share of their hash. A task that runs again must meet
   its documents in the same order, as it does in files; other tables are better written first.
2. Every distinct word of the corpus is encoded once: a word is an array of byte tokens, and a fold
   merges, again and again, the leftmost pair of the least rank. The ranks come from a literal map;
   the id of a merged pair is its rank, so the fold needs no byte strings.
3. The ids of its words go back to every block in packets, and its documents are put together, some
   STRETCH words at once. Decoding joins the byte pieces of the ids.

Spark searches a map from end to end, so the rank map is a perfect hash table in an array: a pair's
group tells a shift that moves the pairs of the group to slots of their own.

Words over LONG bytes are folded in pieces: each next piece is merged together with the last tokens
before it. Where the first of these tokens comes out unchanged, all before it stands, since a
sequence of tokens is the encoding of its bytes if every two neighbours are that of theirs; else
more tokens are taken, in the end all. So the work of a word grows with its length.

A NULL or empty text has no tokens: its digests are those of the empty string. A very long text is one
block, put together by one task. Rows that repeat, also with one id, are rows of the result each; a NULL
id stays NULL; an empty table gives no rows. Ties of ranks go to the leftmost pair. Columns other
than doc_id and text are not looked at. Letters and digits that the JVM's Unicode version does not
know yet are taken from the library's.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, plain, shuffle_width, slices
from .gather import gathered, offsets, written

LONG = 96  # bytes of a word that are folded at once
BLOCK = 64 << 20  # bytes of the words of a block
STRETCH = 1 << 18  # words that are put together at once
PACK = 1 << 18  # words whose ids a task packs at once
TOP = 1 << 16  # above all ids


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankMap:
    """The rank map as literals: what two ids merge to, ids of single bytes, bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.end = max(ranks.values(), default=0) + 1  # stands at both ends of a word; merges with nothing
        if self.end >= TOP:
            raise ValueError(f"ids must be below {TOP}")
        group = [_spark_hash(right, left) for left, right, _ in pairs]
        spot = [_spark_hash(left, right) for left, right, _ in pairs]
        self.groups, self.slots, shift = _displaced(group, spot)
        entries = [-1] * self.slots
        for g, s, (left, right, rank) in zip(group, spot, pairs):
            entries[(s ^ shift[g % self.groups]) % self.slots] = (left * TOP + right) * TOP + rank
        self.shift, self.entries = _literal(shift, "array<bigint>"), _literal(entries, "array<bigint>")
        self.bytes_ = _literal([ranks[bytes([b])] for b in range(256)], "array<bigint>")
        pieces = [""] * self.end
        for token, r in ranks.items():
            pieces[r] = token.hex()
        self.pieces = _literal(pieces, "array<string>")

    def link(self, left: Column, right: Column) -> Column:
        """A token with what follows it: its id, and above that the rank of the pair, or TOP * 2 where it does not merge.

        The slot holds one entry of pair and rank; less the pair asked for, only its own entry leaves a rank.
        """
        shift = F.get(self.shift, F.pmod(F.xxhash64(right, left), F.lit(self.groups)).cast("int"))
        entry = F.get(self.entries, F.pmod(F.xxhash64(left, right).bitwiseXOR(shift), F.lit(self.slots)).cast("int"))
        rank = F.pmod(entry - (left * F.lit(TOP**2) + right * F.lit(TOP)), F.lit(TOP**3))
        return F.least(rank, F.lit(2 * TOP)) * F.lit(TOP) + left


def _spark_hash(*numbers: int) -> int:
    """``xxhash64`` of bigint columns."""
    seed = 42
    for x in numbers:
        seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _displaced(group: list[int], spot: list[int]) -> tuple[int, int, list[int]]:
    """Groups, slots, and a shift for each group, so that all (spot ^ shift) % slots differ: the fullest group first."""
    groups, slots = len(spot) // 3 + 1, 3 * len(spot) // 2 + 8
    own: list[list[int]] = [[] for _ in range(groups)]
    for g, s in zip(group, spot):
        own[g % groups].append(s)
    shift, taken = [0] * groups, bytearray(slots)
    for g in sorted(range(groups), key=lambda g: (-len(own[g]), g)):
        x = 0
        while True:
            places = [(s ^ x) % slots for s in own[g]]
            if not any(taken[p] for p in places) and len(set(places)) == len(places):
                break
            x += 1
        shift[g] = x
        for p in places:
            taken[p] = 1
    return groups, slots, shift


def _literal(values: list, kind: str) -> Column:
    """A long array as one literal: the optimizer folds the constant."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def bytes_of(word: Column) -> Column:
    """The bytes of a string or binary as an array of numbers."""
    latin = F.decode(word.cast("binary"), "ISO-8859-1")
    return F.transform(F.split(latin, ""), F.ascii)


def _merge(ranks: RankMap, q: Column) -> Column:
    """One merge of the leftmost pair of least rank, or ``q`` itself where no pair merges.

    q: the tokens between two end marks, each as ``link`` gives it, so the least one tells the pair.
    """
    least = F.array_min(q)
    place = F.when(least < TOP**2, F.array_position(q, least).cast("int")).otherwise(0)

    def merged(at: Column) -> Column:
        new = F.shiftright(F.get(q, at - 1), 16)
        pair = F.zip_with(F.array(_id(F.get(q, at - 2)), new), F.array(new, _id(F.get(q, at + 1))), ranks.link)
        return F.when(at > 0, F.flatten(F.array(F.slice(q, F.lit(1), at - 2), pair, F.slice(q, at + 2, F.size(q))))).otherwise(q)

    return F.get(F.transform(F.array(place), merged), 0)


def _id(x: Column) -> Column:
    return x.bitwiseAND(F.lit(TOP - 1).cast("bigint"))


def fold(ranks: RankMap, ids: Column) -> Column:
    """Ids (bigint) of a stretch of tokens after all merges."""
    end = F.array(F.lit(ranks.end).cast("bigint"))
    begin = F.get(F.transform(F.array(ids), lambda x: F.zip_with(F.flatten(F.array(end, x, end)), F.flatten(F.array(x, end, end)), ranks.link)), 0)
    return F.aggregate(F.sequence(F.lit(1), F.size(ids)), begin, lambda q, _: _merge(ranks, q), lambda q: F.transform(F.slice(q, F.lit(2), F.size(q) - 2), _id))


def _byte_ids(ranks: RankMap, word: Column) -> Column:
    return F.transform(bytes_of(word), lambda b: F.get(ranks.bytes_, b))


def _appended(ranks: RankMap, before: Column, piece: Column) -> Column:
    """The encoding of the bytes of ``before`` (ids of an encoding) and ``piece`` (ids of bytes) together."""
    tries = F.array(F.lit(4), F.lit(32), F.lit(256), F.lit(2**30))

    def attempt(done: Column, k: Column) -> Column:
        n = F.least(k, F.size(before))
        tail = F.slice(before, F.size(before) - n + 1, n)
        own = F.flatten(F.transform(tail, lambda t: _byte_ids(ranks, F.unhex(F.get(ranks.pieces, t.cast("int"))))))
        joined = F.transform(F.array(fold(ranks, F.concat(own, piece))), lambda f: F.when((n == F.size(before)) | (F.get(f, 0) == F.get(tail, 0)), F.concat(F.slice(before, F.lit(1), F.size(before) - n), f)))
        return F.coalesce(done, F.get(joined, 0))

    return F.aggregate(tries, F.lit(None).cast("array<bigint>"), attempt)


def encode_word(ranks: RankMap, word: Column) -> Column:
    """Ids of one word (string, not empty)."""
    whole = fold(ranks, _byte_ids(ranks, word))
    raw = word.cast("binary")
    spots = F.sequence(F.lit(1), F.octet_length(word), F.lit(LONG))
    pieces = F.aggregate(spots, F.array().cast("array<bigint>"), lambda ids, at: _appended(ranks, ids, _byte_ids(ranks, F.substr(raw, at, F.lit(LONG)))))
    return F.when(F.octet_length(word) <= LONG, whole).otherwise(pieces)


@lru_cache(maxsize=1)
def _later_letters(unknown: tuple[tuple[int, int], ...]) -> dict[str, str]:
    """For \\p{L} and \\p{N}: ranges of the code points (of the given ranges) that the library puts there."""
    import tiktoken

    out = {}
    for kind in ("L", "N"):
        tells = tiktoken.Encoding("class", pat_str=rf"\p{{{kind}}}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        have = np.array([c for lo, hi in unknown for block in range(lo, hi + 1, 256) if tells.encode_ordinary("".join(map(chr, range(block, min(block + 255, hi) + 1)))) for c in range(block, min(block + 255, hi) + 1) if tells.encode_ordinary(chr(c))], np.int64)
        starts = have[np.diff(have, prepend=-2) > 1]
        ends = have[np.diff(have, append=1 << 40) > 1]
        out[kind] = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in zip(starts.tolist(), ends.tolist()))
    return out


def jvm_pattern(spark: SparkSession, pattern: str) -> str:
    """The splitting pattern for the JVM: white space of all scripts, letters and digits as the library has them."""
    code = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    unknown = spark.range(0, 0x110000, 1, 1).filter("id not between 55296 and 57343").filter(code.rlike(r"\p{Cn}"))
    # runs of unassigned code points: one row each, some hundreds
    runs = unknown.select("id", (F.col("id") - F.monotonically_increasing_id()).alias("run")).groupBy("run").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    for kind, ranges in _later_letters(tuple((r.lo, r.hi) for r in runs)).items():
        if ranges:
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}[\p{{Cn}}&&[{ranges}]]]")
    return "(?U)" + pattern


_ROWS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("data", pa.binary()), ("words", pa.list_(pa.string())), ("numbers", pa.list_(pa.int32()))])
_ROWS_SQL = "key long, id long, data binary, words array<string>, numbers array<int>"


def _blocks(shares: int) -> Callable:
    """Two kinds of rows. Documents: key is their block, id their doc_id, data the numbers of their words.
    Words of a share (-1 - key) and block (id): no data, and the words with their numbers."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            words = batch.column("words")
            flat, rows = words.flatten(), offsets(np.diff(words.offsets.to_numpy()))
            kind = np.int64 if pa.types.is_large_string(flat.type) else np.int32
            at = np.frombuffer(flat.buffers()[1], kind)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, kind)
            for lo, hi in slices(at[rows], BLOCK):
                own = flat.slice(rows[lo], rows[hi] - rows[lo]).dictionary_encode()
                # numbers by falling frequency: most are small, and their high bytes pack to almost nothing
                which, n = own.indices.to_numpy(), len(own.dictionary)
                number = np.empty(n, "<u4")
                number[np.argsort(-np.bincount(which, minlength=n), kind="stable")] = np.arange(n)
                ends = (rows[lo : hi + 1] - rows[lo]).tolist()
                data = pa.array([_packed(number[which[x:y]]) for x, y in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, block)), batch.column("doc_id").slice(lo, hi - lo), data, pa.nulls(hi - lo, _ROWS.field("words").type), pa.nulls(hi - lo, _ROWS.field("numbers").type)], schema=_ROWS
                )
                if n:
                    share = (pd.util.hash_array(own.dictionary.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(shares)).astype(np.int64)
                    order = np.argsort(share, kind="stable")
                    cuts = np.flatnonzero(np.diff(share[order], prepend=-1, append=-1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(-1 - share[order][cuts[:-1]]), pa.array(np.full(len(cuts) - 1, block)), pa.nulls(len(cuts) - 1, pa.binary()),
                            pa.ListArray.from_arrays(cuts, own.dictionary.take(pa.array(order)).cast(pa.string())), pa.ListArray.from_arrays(cuts, pa.array(number[order].astype(np.int32))),
                        ],
                        schema=_ROWS,
                    )
                block += 1
        give_back()

    return run


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as their count and compressed planes of bytes, lowest first, as many as they need."""
    planes = (int(numbers.max(initial=0)).bit_length() + 7) // 8
    rows = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:planes])
    return len(numbers).to_bytes(8, "little") + bytes([planes]) + pa.compress(rows.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, planes = int.from_bytes(data[:8], "little"), data[8]
    rows = np.zeros((n, 4), np.uint8)
    rows[:, :planes] = np.frombuffer(pa.decompress(data[9:], n * planes, "zstd", asbytes=True), np.uint8).reshape(planes, n).T
    return rows.view("<u4").ravel().astype(np.int64)


_PACKETS_SQL = "of long, numbers binary, sizes binary, ids binary"


def _packets(batches) -> Iterator[pa.RecordBatch]:
    """The ids of words (of, number, ids), some PACK words at once, packed for each block."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        of, number, ids = (rows.column(c).combine_chunks() for c in ("of", "number", "ids"))
        of, number = of.to_numpy(), number.to_numpy()
        pool, at = ids.flatten().to_numpy(), offsets(np.diff(ids.offsets.to_numpy()))
        order = np.lexsort((number, of))
        cuts = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1)).tolist()
        parts = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            mine = order[x:y]
            parts.append((int(of[mine[0]]), _packed(np.diff(number[mine], prepend=0)), _packed(np.diff(at)[mine]), _packed(gathered(pool, at, mine)[0])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int64(), *[pa.binary()] * 3))], names=["of", "numbers", "sizes", "ids"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACK:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _pool(packets: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words of a block by number, one after the other, and the n+1 offsets of the words."""
    numbers, sizes, ids = ([_unpacked(x) for x in packets.column(c).to_pylist()] for c in ("numbers", "sizes", "ids"))
    none = [np.zeros(0, np.int64)]
    order = np.argsort(np.concatenate([*none, *(np.cumsum(x) for x in numbers)]), kind="stable")
    at = offsets(np.concatenate([*none, *sizes]))
    return gathered(np.concatenate([*none, *ids]).astype(np.uint16), at, order)


def _put_together(answer: Callable, schema: pa.Schema) -> Callable:
    """For the documents of a block and the packets of its words: ``answer`` to ids and the documents' offsets in them."""

    def run(key, docs: pa.Table, packets: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # words
            return schema.empty_table()
        pool, at = _pool(packets)
        data, names = docs.column("data").to_pylist(), docs.column("id").combine_chunks()
        out = []
        for lo, hi in slices(offsets(np.array([int.from_bytes(x[:8], "little") for x in data])), STRETCH):
            numbers = [_unpacked(x) for x in data[lo:hi]]
            ids, total = gathered(pool, at, np.concatenate(numbers))
            out.append(pa.Table.from_arrays([names.slice(lo, hi - lo), *answer(ids.astype(np.int64), total[offsets(np.array([len(x) for x in numbers]))])], schema=schema))
        give_back()
        return pa.concat_tables(out)

    return run


def word_ids(docs: DataFrame, ranks: RankMap, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_blocks``, and the ids of the words of the blocks (of (a block), number, ids)."""
    texts = plain(docs, "doc_id", "text")
    words = F.regexp_extract_all("text", F.lit(jvm_pattern(docs.sparkSession, pattern)), F.lit(0))
    cut = texts.select("doc_id", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    # the fold is the work here, so the words are dealt to many tasks, however small they are
    width = 4 * shuffle_width(docs.sparkSession)
    rows = cut.mapInArrow(_blocks(2 * width), _ROWS_SQL).repartition(width, "key")
    # a filter of documents would go below the exchange, and columns not asked for too: then the texts were cut twice
    listed = rows.select("key", "id", "data", F.explode_outer(F.arrays_zip("words", "numbers")).alias("w"))
    listed = listed.select("key", "w.words", F.struct("id", "w.numbers").alias("place"), "data").filter("length(words) >= coalesce(octet_length(data), 0)")
    places = listed.withColumnRenamed("words", "word").groupBy("word", "key").agg(F.collect_list("place").alias("places"))
    encoded = places.select(encode_word(ranks, F.col("word")).cast("array<int>").alias("ids"), "places")
    return rows, encoded.select(F.explode("places").alias("place"), "ids").select(F.col("place.id").alias("of"), F.col("place.numbers").alias("number"), "ids")


def _answered(docs: DataFrame, ranks: dict[bytes, int], pattern: str, answer: Callable, schema: pa.Schema, sql: str) -> DataFrame:
    rows, words = word_ids(docs, RankMap(ranks), pattern)
    packets = words.mapInArrow(_packets, _PACKETS_SQL)
    return rows.groupBy("key").cogroup(packets.groupBy("of")).applyInArrow(_put_together(answer, schema), sql)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, ids (array of int)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _answered(docs, read_ranks(ranks_path), pattern, lambda ids, at: [pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32))], schema, "doc_id long, ids array<int>")


def decoder(ranks: dict[bytes, int]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For ids: the bytes of their pieces, one after the other, and the n+1 offsets of the pieces."""
    size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    size[list(ranks.values())] = [len(t) for t in ranks]
    pool = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
    return lambda ids: gathered(pool, offsets(size), ids)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the bytes decoded from them)."""
    decode = decoder(read_ranks(ranks_path))

    def digests(ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        before = np.full(len(ids), ord(","), np.uint8)
        before[at[:-1][at[1:] > at[:-1]]] = 0
        text, size = written(ids, before)
        raw, ends = decode(ids)
        return [pa.array(np.diff(at)), *(_hashed(x.tobytes(), e[at]) for x, e in ((text, offsets(size)), (raw, ends)))]

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _answered(docs, read_ranks(ranks_path), pattern, digests, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _hashed(data: bytes, at: np.ndarray) -> pa.Array:
    return pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())
