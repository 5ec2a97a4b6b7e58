"""Token-ID binary output: length-delimited records with masked checksums, and an offset index.

A shard is ``tokens-NNNNNN.bin``: records one after the other, each

    uint64  payload length                    (little-endian throughout)
    uint32  masked CRC-32 of these 8 bytes
    bytes   payload: uint8 "has id", int64 id, then the token ids (uint16, or uint32 for large vocabularies)
    uint32  masked CRC-32 of the payload

and ``tokens-NNNNNN.idx``: the int64 byte offsets of its records and, last, the size of the shard, so
that a reader can fetch records in any order. Masking turns the checksum by 15 bits and adds a
constant, so that checksums of data that hold checksums stay useful.

Rows are dealt to shards by ranges of the id and sorted inside, so shard after shard the ids ascend
(NULL first; rows with one id by their text). NULL and empty texts give records of the end id alone.
Rows that repeat are written as often as they come. An empty table gives no shard.

A very long text is one record, written by one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_dir
from .common import parts, plain, saved
from .tokens import encoder, vocabulary

_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<?q")
_TAIL = struct.Struct("<I")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _TAIL.pack(masked(size)), payload, _TAIL.pack(masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; raises where length or checksum is wrong."""
    size, crc = _HEAD.unpack_from(record)
    if crc != masked(record[:8]) or size != len(record) - 16:
        raise ValueError("record length is damaged")
    payload = record[12:-4]
    if _TAIL.unpack_from(record, len(record) - 4)[0] != masked(payload):
        raise ValueError("record payload is damaged")
    return payload


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI; every scheme Arrow knows, or a plain path."""
    if folder.startswith("/"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, vocab: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, enc = TaskContext.get(), encoder(vocab)
    shard = task.partitionId()
    fs, base = _filesystem(folder)
    name, tag = f"{base}/tokens-{shard:06d}", f"tmp{task.taskAttemptId()}"
    end, out, offsets, tokens = np.array([end_id], enc.kind).tobytes(), None, [0], 0
    for batch, raw, ends in parts(batches):
        if out is None:
            fs.create_dir(base, recursive=True)
            out = fs.open_output_stream(f"{name}.bin.{tag}")
        ids, at = enc.encode(raw, ends)
        data, w = ids.tobytes(), enc.kind.itemsize
        tokens += len(ids) + len(batch)
        for k, doc in enumerate(batch.column("doc_id").to_pylist()):
            record = frame(_ID.pack(doc is not None, doc or 0) + data[at[k] * w : at[k + 1] * w] + end)
            out.write(record)
            offsets.append(offsets[-1] + len(record))
    if out is None:
        return
    out.close()
    with fs.open_output_stream(f"{name}.idx.{tag}") as index:
        index.write(np.array(offsets, "<i8").tobytes())
    for kind in ("bin", "idx"):
        fs.move(f"{name}.{kind}.{tag}", f"{name}.{kind}")
    yield pa.RecordBatch.from_pydict({"shard": [shard], "n_records": [len(offsets) - 1], "n_tokens": [tokens]}, schema=pa.schema([("shard", pa.int64()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]))


def write_records(docs: DataFrame, folder: str, *, vocab: str, end_id: int = 0) -> DataFrame:
    """Write the token records of ``docs`` (doc_id, text); one manifest row per shard.

    Manifest: shard, n_records, n_tokens. A task writes under a name of its own and renames when it
    is whole, so a task that runs again puts the same shard in the same place.
    """

    dealt = plain(docs, "doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return saved(dealt.mapInArrow(lambda b: _write_shard(b, folder, vocab, end_id), "shard long, n_records long, n_tokens long"), "manifest")


def read_records(folder: str, shard: int, width: int, order=None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of a shard's records: in file order, or those numbered in ``order``, e.g. shuffled."""
    fs, base = _filesystem(folder)
    with fs.open_input_file(f"{base}/tokens-{shard:06d}.idx") as f:
        offsets = np.frombuffer(f.read(), "<i8")
    kind = np.dtype(f"<u{width}")
    with fs.open_input_file(f"{base}/tokens-{shard:06d}.bin") as f:
        if order is None:
            lo = 0
            while lo < len(offsets) - 1:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (8 << 20), side="right")) - 1)
                block = f.read_at(int(offsets[hi] - offsets[lo]), int(offsets[lo]))
                for k in range(lo, hi):
                    yield _parse(block[offsets[k] - offsets[lo] : offsets[k + 1] - offsets[lo]], kind)
                lo = hi
        else:
            for k in order:
                yield _parse(f.read_at(int(offsets[k + 1] - offsets[k]), int(offsets[k])), kind)


def _parse(record: bytes, kind: np.dtype) -> tuple[int | None, np.ndarray]:
    payload = unframe(record)
    known, doc = _ID.unpack_from(payload)
    return (doc if known else None), np.frombuffer(payload, kind, offset=_ID.size)


def _digest_shards(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            for doc, ids in read_records(folder, shard, width):
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)


def token_digests(spark: SparkSession, folder: str, manifest: DataFrame, *, width: int) -> DataFrame:
    """Per record read back from the files: doc_id, start, n_tokens, ids_crc32 (ids as uint32).

    The driver sees the manifest only: three numbers for each shard, whatever its size.
    """
    shards, before = [], 0
    for shard, tokens in sorted((r.shard, r.n_tokens) for r in manifest.select("shard", "n_tokens").toLocalIterator()):
        shards.append((shard, before))
        before += tokens

    listed = spark.createDataFrame(shards, "shard long, before long")
    return listed.repartition(max(1, len(shards)), "shard").mapInArrow(lambda b: _digest_shards(b, folder, width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, vocab_name: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write the records of ``docs`` below the shared folder and give the digests of what the files hold."""
    spark, vocab = docs.sparkSession, vocabulary(vocab_name)
    folder = fresh_dir(spark, "token-files")
    manifest = write_records(docs, folder, vocab=vocab, end_id=end_id)
    return token_digests(spark, folder, manifest, width=encoder(vocab).kind.itemsize)
