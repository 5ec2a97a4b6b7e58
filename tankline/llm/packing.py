"""Best-fit packing of token sequences, by hierarchical residual packing.

Each task packs its own pieces best-fit decreasing. Bins that are nearly full are final; the
underfull ones travel on as items, with their members (at most one for each token), to a round over
fewer tasks, until one task has what is left or the bins of a round are too many for one task. Every
round is written, so a lost executor costs a task, not a tree.

NULL and empty texts pack as the end id alone; rows that repeat are packed as often as they come; an
empty table gives no rows. Columns other than doc_id and text are not looked at.

A very long text is encoded by one task and cut into pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, plain, saved, shuffle_width
from .tokens import encoder, vocabulary

_PIECE = "doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint"
_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
_BIN = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int64()), ("final", pa.bool_()), ("members", _MEMBERS)])
_BIN_SQL = f"sequence_id long, fill long, final boolean, members array<struct<{_PIECE}>>"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. Bins are kept by the room they have left;
    a bit set of the rooms in use finds the smallest that is enough."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, []
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        rooms[room - size].append(b)
        used |= 1 << (room - size)
    return bins


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a sequence's pieces: whole pieces at the end, the shorter one first."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))]


def _rows(bins, members, fills, base: int, capacity: int, slack: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Bins as rows; numbered from ``base``."""
    for lo in range(0, len(bins), 2000):
        out: dict[str, list] = {"sequence_id": [], "fill": [], "final": [], "members": []}
        for k, items in enumerate(bins[lo : lo + 2000], lo):
            fill = sum(int(fills[i]) for i in items)
            out["sequence_id"].append(base + k)
            out["fill"].append(fill)
            out["final"].append(last or fill >= capacity - slack)
            out["members"].append([m for i in items for m in members[i]])
        yield pa.RecordBatch.from_pydict(out, schema=_BIN)


def _first_round(batches, vocab: str, capacity: int, slack: int, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, pieces = encoder(vocab), []
    for batch, raw, ends in parts(batches):
        ids, at = enc.encode(raw, ends)
        wide = np.append(ids, 0).astype("<u4")
        for k, doc in enumerate(batch.column("doc_id").to_pylist()):
            own = wide[at[k] : at[k + 1] + 1].copy()
            own[-1] = end_id
            for piece, (start, length) in enumerate(cut_pieces(len(own), capacity)):
                pieces.append((doc, piece, start, length, zlib.crc32(own[start : start + length].tobytes())))
    lengths = np.array([p[3] for p in pieces], np.int64)
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    members = [[dict(zip(names, p))] for p in pieces]
    yield from _rows(best_fit(lengths, capacity), members, lengths, TaskContext.get().partitionId() << 32, capacity, slack, False)


def _next_round(batches, level: int, capacity: int, slack: int, last: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    fills, members = [], []
    for batch in batches:
        fills += batch.column("fill").to_pylist()
        members += batch.column("members").to_pylist()
    fills = np.array(fills, np.int64)
    base = level << 56 | TaskContext.get().partitionId() << 32
    yield from _rows(best_fit(fills, capacity), members, fills, base, capacity, slack, last)


def pack_documents(
    docs: DataFrame, *, vocab_name: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 2, slack: int = 4, fan_in: int = 8, task_bins: int = 100_000
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    slack: a bin with at most so much room is final before the last round. fan_in: tasks of one round
    that meet in one task of the next. task_bins: a round never gives a task more bins than about
    this; if the bins left are more, the tree ends with several tasks in its last round.
    """
    vocab = vocabulary(vocab_name)
    bins = saved(plain(docs, "doc_id", "text").mapInArrow(lambda b: _first_round(b, vocab, capacity, slack, end_id), _BIN_SQL), "pack0")
    done, left = [bins.filter("final")], bins.filter("not final")
    level, tasks = 1, max(1, shuffle_width(docs.sparkSession))
    while True:
        tasks = max(1, -(-tasks // fan_in), -(-left.count() // task_bins))
        # a round that can't have fewer tasks than the one before is the last
        last = tasks == 1 or level > 1 and tasks >= before
        before = tasks
        packed = saved(left.select("fill", "members").repartition(tasks).mapInArrow(lambda b, level=level, last=last: _next_round(b, level, capacity, slack, last), _BIN_SQL), f"pack{level}")
        done.append(packed if last else packed.filter("final"))
        if last:
            break
        left, level = packed.filter("not final"), level + 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    # places inside a bin: running sum over its members, in their order
    running = F.aggregate(
        "members",
        F.expr(f"named_struct('at', 0L, 'out', cast(array() as array<struct<{_PIECE},offset:bigint>>))"),
        lambda acc, m: F.struct(
            (acc["at"] + m["length"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(*(m[c].alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), acc["at"].alias("offset")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return whole.select("sequence_id", F.explode(running).alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
