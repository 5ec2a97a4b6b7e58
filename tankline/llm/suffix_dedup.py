"""Removal of repeated byte strings with per-shard suffix arrays.

Every byte covered by a WINDOW-byte string that starts anywhere else too goes; strings never run from
one document into the next and are judged on the input.

1. Anchors. Of the GRAM-byte strings in a window the one with the least hash is its anchor, so equal
   windows have equal anchors at equal places. A window can only repeat if its anchor does. Anchors
   are counted by the hash of their string and of their context, which holds all windows they stand
   for. Contexts that occur twice are repeats from end to end; contexts whose anchor occurs only once
   have none. What is left, contexts that share an anchor and differ somewhere, goes to shards.
2. Shards. Contexts are dealt to shards by their anchor, the contexts of a very common anchor over
   several. Each shard builds the suffix array of its contexts by Larsson-Sadakane refinement (ranks
   double in depth, finished groups are left alone) and the common prefixes of neighbours by Kasai's
   method; runs of suffixes with WINDOW bytes in common and different places are repeats.
3. Merging. Shards that share an anchor give their windows that are not yet known to repeat, and one
   of each repeat, as runs sorted by 128-bit fingerprints, cut into ranges; windows of a range that
   have an equal one at another place are repeats.

Results: a row for each input row. NULL and empty texts have no bytes. Equal rows are documents like
any others, so all they hold that is long enough goes; ids may repeat or be NULL. Texts are UTF-8
bytes; a cut may fall inside a character, which is why the kept bytes are binary. Other columns are
not looked at; an empty table gives no rows.

A very long text is hashed whole by one task; only its contexts go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, mix, parts, plain, row_key, saved, shuffle_width

WINDOW, GRAM = 200, 64
SPAN = WINDOW - GRAM + 1  # anchors in a window
SHARD = 2000  # contexts in a shard
_MOST = np.uint64(np.iinfo(np.uint64).max)
_MARK = "row long, lo long, hi long"


@lru_cache(maxsize=1)
def _hashers() -> tuple[Rolling, Rolling]:
    return Rolling(61), Rolling(67)


def _slide(v: np.ndarray, op, fill) -> np.ndarray:
    """Least or greatest of SPAN neighbours, from prefixes and suffixes of blocks of SPAN."""
    n = len(v) - SPAN + 1
    x = np.concatenate([v, np.full(-len(v) % SPAN, fill, np.uint64)]).reshape(-1, SPAN)
    ahead = op.accumulate(x, axis=1).ravel()
    back = op.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[SPAN - 1 : SPAN - 1 + n])


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, hash of each and of its context, and where its context starts and ends."""
    none = np.zeros(0, np.int64)
    if len(raw) < WINDOW:
        return none, none, none, none, none
    one, two = _hashers()
    one.load(raw)
    at = np.arange(len(raw) - GRAM + 1)
    h = one.hashes(at, at + GRAM)
    # windows that would run over the end of a row choose nothing
    whole = np.zeros(len(raw) - WINDOW + 1, bool)
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= WINDOW:
            whole[a : b - WINDOW + 1] = True
    least = _slide(h, np.minimum, _MOST)
    chosen = np.concatenate([np.zeros(SPAN - 1, np.uint64), np.where(whole, least, 0), np.zeros(SPAN - 1, np.uint64)])
    p = np.flatnonzero((_slide(chosen, np.maximum, 0) == h) & (h > 0))
    # the windows that have chosen an anchor lie side by side: a run of equal least hashes
    least = np.where(whole, least, 0)
    first = np.flatnonzero(np.diff(least, prepend=~least[:1]))
    last = np.append(first[1:], len(least)) - 1
    run = np.searchsorted(first, p, side="right") - 1
    while len(far := np.flatnonzero(least[first[run]] != h[p])):
        run[far] -= 1
    lo, hi = np.maximum(first[run], p - (SPAN - 1)), np.minimum(last[run], p) + WINDOW
    two.load(raw)
    g = mix(two.hashes(lo, hi) + (p - lo).astype(np.uint64))
    return p, h[p].view(np.int64), g.view(np.int64), lo, hi


def _packed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Start and size of a context in one number; a context has under 512 bytes."""
    return lo << 9 | (hi - lo)


def _anchor_rows(batches) -> Iterator[pa.RecordBatch]:
    """Anchors, one row for all equal contexts among about 32 MB of text; n tells if there were several.

    ``at`` tells where its context is (see ``_packed``). The contexts that repeat among them are given
    as marks (n = 0, h to g) at once.
    """
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        h, g, row, lo, hi = np.concatenate(held, axis=1)
        held.clear()
        order = np.lexsort((g, h))
        h, g, row, lo, hi = (x[order] for x in (h, g, row, lo, hi))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(h))
        again = np.flatnonzero(np.repeat(n, n) > 1)
        row_, lo_, hi_ = joined(row[again], lo[again], hi[again])
        names = ["h", "g", "n", "row", "at"]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first], g[first], n.astype(np.int32), row[first], _packed(lo[first], hi[first]))], names=names)
        if len(row_):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lo_, hi_, np.zeros(len(lo_), np.int32), row_, np.zeros(len(lo_), np.int64))], names=names)

    size = 0
    for batch, raw, ends in parts(batches, 1 << 20):
        p, h, g, lo, hi = anchors(raw, ends)
        if not len(p):
            continue
        at = np.searchsorted(ends, p, side="right") - 1
        row = batch.column("row").to_numpy(zero_copy_only=False)[at]
        held.append(np.stack([h, g, row, lo - ends[at], hi - ends[at]]))
        size += len(raw)
        if size > 32 << 20:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def joined(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of rows with those that touch or overlap made one."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    # rows one after the other on one line
    base = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])]) * (int(hi.max()) + 2)
    far = np.maximum.accumulate(hi + base)
    new = np.ones(len(row), bool)
    new[1:] = lo[1:] + base[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], lo[first], far[last] - base[last]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of at least their first ``depth`` bytes, by Larsson-Sadakane refinement, and
    whether each differs from the one before it in so many."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8 + -len(text) % 8, np.uint8)])
    key = as_strided(padded.view(np.uint64), (n,), (1,)).byteswap()
    sa = np.argsort(key).astype(np.int32)
    sorted_key = key[sa]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int32)
    start = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank[sa] = start
    h = 8
    while h < depth:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        own = sa[open_]
        after = own.astype(np.int64) + h
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.argsort(start[open_].astype(np.int64) << 32 | (nxt + 1), kind="stable")
        own, nxt, group = own[order], nxt[order], start[open_]
        sa[open_] = own
        changed = np.ones(len(open_), bool)
        changed[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        new[open_] = changed
        start[open_] = np.maximum.accumulate(np.where(changed, open_, 0)).astype(np.int32)
        rank[own] = start[open_]
        h *= 2
    return sa, new


def common_prefixes(text: np.ndarray, sa: np.ndarray, new: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start within ``starts`` to ``ends``, in the order of ``sa``, and the bytes each
    has in common with the one before it, at most ``most``.

    Kasai's method: going from left to right, a prefix loses at most one byte from a suffix to the
    next. All stretches are gone through side by side. It begins anew where the suffix compared with
    was the last of its stretch; and suffixes that the refinement left together have ``most`` bytes in
    common, but as their order is open, one that follows such a suffix and is none begins anew too.
    """
    n = len(text)
    size = ends - starts
    asked = np.zeros(n + 1, bool)
    asked[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())] = True
    own = asked[sa]
    group = np.cumsum(new, dtype=np.int32)[own]
    order = sa[own]
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    together = np.zeros(n, bool)
    together[order[1:]] = group[1:] == group[:-1]
    wide = np.concatenate([text, np.full(most + 16 + -len(text) % 8, 255, np.uint8)])
    words = as_strided(wide[: len(wide) // 8 * 8].view(np.uint64), (len(wide) - 15,), (1,))
    plcp = np.zeros(n, np.int32)
    live, have, chain = np.arange(len(starts)), np.zeros(len(starts), np.int32), np.zeros(len(starts), bool)
    for step in range(int(size.max(initial=0))):
        stay = size[live] > step
        if not stay.all():
            live, have, chain = live[stay], have[stay], chain[stay]
        i = starts[live] + step
        j = before[i]
        length = np.where(chain & (have < most), np.maximum(have - 1, 0), 0)
        same = together[i]
        length[same] = most
        go = np.flatnonzero((j >= 0) & ~same)
        a, b, m = i[go], j[go], length[go]
        while len(go):
            diff = words[a + m] ^ words[b + m]
            m += np.where(diff == 0, 8, np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)) >> 3).astype(m.dtype)
            on = (diff == 0) & (m < most) & (np.maximum(a, b) + m < n)
            off = ~on
            length[go[off]] = np.minimum(m[off], most)
            go, a, b, m = go[on], a[on], b[on], m[on]
        plcp[i] = length
        have, chain = length, (j >= 0) & asked[j + 1]
    return order, plcp[order]


def _shard_repeats(ctx: list[bytes], row: np.ndarray, lo: np.ndarray):
    """For a shard's contexts: where each starts in the joined text, which starts are windows, the group
    of each window (equal windows share one) and whether its group has two places."""
    size = np.array([len(c) for c in ctx])
    text = np.frombuffer(b"".join(ctx) + bytes(WINDOW), np.uint8)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    sa, new = suffix_array(text, WINDOW)
    owner = np.repeat(np.arange(len(ctx)), size)
    inside = np.arange(len(owner)) - starts[owner]
    at, common = common_prefixes(text, sa, new, starts, starts + size - WINDOW + 1, WINDOW)
    # runs of suffixes with a whole window in common
    group = np.cumsum(common < WINDOW)
    at = at.astype(np.int64)
    place_row, place = row[owner[at]], lo[owner[at]] + inside[at]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    differ = (place_row != np.repeat(place_row[first], np.diff(first, append=len(at)))) | (place != np.repeat(place[first], np.diff(first, append=len(at))))
    twice = np.add.reduceat(differ, first) > 0 if len(first) else np.zeros(0, bool)
    number = np.repeat(np.arange(len(first)), np.diff(first, append=len(at)))
    return text, owner, inside, at, number, twice


def _shard(table: pa.Table, bits: int) -> pa.Table:
    """Marks of one shard (kind 0), and for anchors on several shards the runs to merge (kind 1):
    fingerprints in order, row and place of each window, and whether it is known to repeat, in 2**bits ranges."""
    order = np.lexsort((table.column("lo").to_numpy(), table.column("row").to_numpy()))
    table = table.take(pa.array(order))
    ctx = [x.as_py() for x in table.column("ctx")]
    row, lo = table.column("row").to_numpy(), table.column("lo").to_numpy()
    split = table.column("split").to_numpy(zero_copy_only=False).astype(bool)
    out = {k: [] for k in ("kind", "part", "row", "lo", "hi", "run")}
    if ctx:
        text, owner, inside, at, number, twice = _shard_repeats(ctx, row, lo)
        hit = at[twice[number]]
        r, a, b = joined(row[owner[hit]], lo[owner[hit]] + inside[hit], lo[owner[hit]] + inside[hit] + WINDOW)
        out["kind"] += [0] * len(r)
        out["part"] += [0] * len(r)
        out["row"] += r.tolist()
        out["lo"] += a.tolist()
        out["hi"] += b.tolist()
        out["run"] += [None] * len(r)
        # one of each group goes to the merge, for anchors that other shards have too
        one = np.zeros(len(at), bool)
        one[np.flatnonzero(np.diff(number, prepend=-1))] = True
        go = np.flatnonzero(split[owner[at]] & one)
        if len(go):
            hashers = _hashers()
            prints = []
            for hasher in hashers:
                hasher.load(text)
                prints.append(hasher.hashes(at[go], at[go] + WINDOW))
            order = np.lexsort((prints[1], prints[0]))
            f, g, go = prints[0][order], prints[1][order], go[order]
            runs = np.stack([f.view(np.int64), g.view(np.int64), row[owner[at[go]]], lo[owner[at[go]]] + inside[at[go]], twice[number[go]].astype(np.int64)])
            piece = (f >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(piece, prepend=-1))
            for x, y in zip(cut, np.append(cut[1:], len(piece))):
                out["kind"].append(1)
                out["part"].append(int(piece[x]))
                for k in ("row", "lo", "hi"):
                    out[k].append(0)
                out["run"].append(runs[:, x:y].tobytes())
    return pa.table([pa.array(out["kind"], pa.int32()), pa.array(out["part"], pa.int64()), pa.array(out["row"], pa.int64()), pa.array(out["lo"], pa.int64()), pa.array(out["hi"], pa.int64()), pa.array(out["run"], pa.binary())], names=list(out))


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """Windows of one range of fingerprints that some other run holds too."""
    runs = [np.frombuffer(x.as_buffer(), np.int64).reshape(5, -1) for x in table.column("run")]
    # two 64-bit halves as one key that compares like the pair
    keys = [np.stack([r[0].view(np.uint64), r[1].view(np.uint64)], axis=1).astype(">u8").copy().view("S16").ravel() for r in runs]
    key, (row, lo, known) = np.concatenate(keys), np.concatenate(runs, axis=1)[2:]
    order = np.argsort(key, kind="stable")
    key, row, lo, known = key[order], row[order], lo[order], known[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(first, append=len(key))
    # overlapping contexts bring a window to several shards; it repeats only if it has another place
    elsewhere = (row != np.repeat(row[first], n)) | (lo != np.repeat(lo[first], n))
    new = np.repeat(np.add.reduceat(elsewhere, first) > 0, n) & (known == 0)
    row, lo = row[new], lo[new]
    row, lo, hi = joined(row, lo, lo + WINDOW)
    return pa.table([pa.array(row), pa.array(lo), pa.array(hi)], names=["row", "lo", "hi"])


def _contexts(batches) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for."""
    for batch, raw, ends in parts(batches):
        out = {k: [] for k in ("h", "row", "lo", "ctx")}
        for k, (row, asked) in enumerate(zip(batch.column("row").to_pylist(), batch.column("asked").to_pylist())):
            own = raw[ends[k] : ends[k + 1]].tobytes()
            for x in asked:
                lo, size = x["at"] >> 9, x["at"] & 511
                out["h"].append(x["h"])
                out["row"].append(row)
                out["lo"].append(lo)
                out["ctx"].append(own[lo : lo + size])
        yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), pa.array(out["row"], pa.int64()), pa.array(out["lo"], pa.int64()), pa.array(out["ctx"], pa.binary())], names=list(out))


def repeats(texts: DataFrame) -> DataFrame:
    """(row, lo, hi): byte ranges of the rows of ``texts`` (row, text) that are covered by repeats."""
    found = saved(texts.mapInArrow(_anchor_rows, "h long, g long, n int, row long, at long"), "anchors")
    marked = found.filter("n = 0").select("row", F.col("h").alias("lo"), F.col("g").alias("hi"))
    rows = found.filter("n > 0")
    several = saved(rows.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "anchors-met")
    met = saved(rows.join(several, "h", "left_semi"), "anchors-shared")
    kinds = met.groupBy("h", "g").agg(F.sum("n").alias("total"), F.min(F.struct("row", "at")).alias("place"))
    kinds = saved(kinds, "contexts-met")
    whole = met.filter("n = 1").join(kinds.filter("total > 1").select("h", "g"), ["h", "g"], "left_semi")
    whole = whole.select("row", F.shiftright("at", 9).alias("lo"), (F.shiftright("at", 9) + F.col("at").bitwiseAND(511)).alias("hi"))
    # anchors with different contexts, one of which is alone, have to be looked at
    looked = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("total").alias("least")).filter("kinds > 1 and least = 1")
    shares = saved(looked.select("h", F.ceil(F.col("kinds") / SHARD).alias("share"), "kinds"), "shares")
    asked = kinds.join(shares, "h").groupBy("place.row").agg(F.collect_list(F.struct("h", "place.at")).alias("asked"))
    contexts = texts.join(asked, "row").select("row", "asked", "text").dropDuplicates(["row"]).mapInArrow(_contexts, "h long, row long, lo long, ctx binary")
    total = shares.agg(F.sum("kinds")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    dealt = contexts.join(shares, "h").select(
        F.pmod(F.xxhash64("h", F.when(F.col("share") > 1, F.pmod(F.xxhash64("row", "lo"), F.col("share"))).otherwise(0)), F.lit(shards)).alias("shard"),
        (F.col("share") > 1).alias("split"), "row", "lo", "ctx",
    )
    # a range gets about the windows of a quarter of a shard; shards are dealt explicitly, as their work is not in their bytes
    bits, tasks = max(4, (4 * shards).bit_length()), min(shards, 8 * shuffle_width(texts.sparkSession))
    each = dealt.repartition(tasks, "shard").groupBy("shard")
    done = saved(each.applyInArrow(lambda table: _shard(table, bits), "kind int, part long, row long, lo long, hi long, run binary"), "shards")
    merged = done.filter("kind = 1").select("part", "run").groupBy("part").applyInArrow(_merge, _MARK)
    return marked.unionByName(whole).unionByName(done.filter("kind = 0").select("row", "lo", "hi")).unionByName(merged)


def _cut(batches) -> Iterator[pa.RecordBatch]:
    for batch, raw, ends in parts(batches):
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
        for k, marks in enumerate(batch.column("marks")):
            own = raw[ends[k] : ends[k + 1]]
            spans = marks.values
            removed = n = 0
            if spans is not None and len(spans):
                lo, hi = (spans.field(c).to_numpy() for c in ("lo", "hi"))
                _, lo, hi = joined(np.zeros(len(lo), np.int64), lo, np.minimum(hi, len(own)))
                keep = np.ones(len(own), bool)
                for a, b in zip(lo, hi):
                    keep[a:b] = False
                removed, n, own = int((hi - lo).sum()), len(lo), own[keep]
            out["n_bytes"].append(ends[k + 1] - ends[k])
            out["n_removed"].append(removed)
            out["n_spans"].append(n)
            out["kept"].append(own.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], names=["doc_id", *out])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    spark = docs.sparkSession
    # texts are laid out by row once, so that neither join moves them again
    name = f"texts_{uuid.uuid4().hex}"
    rows = plain(docs, "doc_id", "text").select(row_key().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    width = shuffle_width(spark)
    rows.repartition(width, "row").write.option("compression", "zstd").bucketBy(width, "row").sortBy("row").saveAsTable(name)
    texts = spark.table(name)
    marks = repeats(texts.select("row", "text")).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    return texts.join(marks, "row", "left").select("doc_id", "text", "marks").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digests(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
