"""MinHash near-duplicate detection with odd sketches.

A document's set is its distinct five-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); with
fewer words the whole sequence is one shingle. Documents are linked if 100 * intersection >=
75 * union, and groups are the connected components of the links.

1. Every text gives the hashes of its set, ``samples`` MinHash samples, from them ``bands`` keys (each
   of ``rows`` samples, chosen at random) and an odd sketch: a bitmap whose bits are flipped by the
   samples, so that the XOR of two bitmaps has a population count that tells how many samples differ.
2. Documents with equal sets collapse into a class, whose least id stands for it.
3. Classes that share a band key are candidates. Keys of many classes come first, in passes that only
   save work: each class is dealt to one of its keys (that of the least hash with the pass, which alike
   classes mostly agree on) and there to a task of bounded size, which clusters them by the sketches,
   starting from the groups known so far, and gives one pair for each join of clusters: fewer pairs
   than classes. What is confirmed makes groups. Then every two classes of such a key that are in
   different groups meet in a block of two shares of the key; the first key that both have answers for
   them, whatever others they share. What passes there is given as pairs, or, where there are more than
   PAIRS for each class, as the classes concerned, and the full sets of these are then compared in the
   same block, all that are in different groups.
4. Candidates pass if the sketches estimate a similarity of at least CUT, and are confirmed on the
   full sets. Keys of few classes then give all their pairs between classes that these links do not
   yet join, which pass and are confirmed alike.
5. Components are drawn over all confirmed links.

With 160 samples and 60 bands of 5, a pair at similarity 0.75 shares no band with a probability of
about 1e-5, and its sketch cuts it with about one of 1e-4; both fall steeply above. Sets are compared
by 64-bit shingle hashes, equal sets by their size and 128 bits.

A NULL or empty text, or one without words, has an empty set and is linked with nothing. A NULL id has
component NULL unless its group holds another id, and is kept only alone. Rows that repeat an id are
one node in the graph; all are kept or none. Other columns are not looked at; an empty table gives no
rows.

A very long text makes one set, in one task; pieces of work are bounded otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, mix, parts, plain, row_key, saved, words
from .graph import components

SAMPLES, ROWS, BANDS, BITS = 160, 5, 60, 1024
SENT_IDS = 1_000_000  # ids of documents in pairs that are sent to the scan of the texts
FEW, CHUNK = 8, 4000  # classes of a key that give all their pairs at once; classes in one share beyond that
SHINGLES = 500_000  # shingles of the classes in one share (4 MB of hashes)
PASSES = 2  # clustering passes, each over other keys; they only save work
PAIRS = 1  # pairs for each class of a block that are given one by one
CUT, NEAR, SAME = 0.6, 0.83, 0.95  # estimates that may be links, that most likely are, of nearly equal sets


@lru_cache(maxsize=1)
def _constants():
    rng = np.random.default_rng(41)
    odd = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
    picks = np.stack([np.sort(rng.choice(SAMPLES, ROWS, replace=False)) for _ in range(BANDS)])
    salt = rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
    spot = rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
    return odd, add, picks, salt, spot, Rolling(23)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, row after row, and the n+1 offsets of the rows."""
    hasher = _constants()[-1]
    starts, stops, first = words(raw, ends)
    hasher.load(LOWER[raw])
    word = hasher.hashes(starts, stops)
    count = np.diff(first)
    many = np.maximum(count - size + 1, np.minimum(count, 1))  # shingles of each row
    row = np.repeat(np.arange(len(count)), many)
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(row))
    length = np.minimum(size, count)[row]
    value = np.zeros(len(row), np.uint64)
    padded = np.append(word, np.zeros(size, np.uint64))
    for k in range(size):
        step = mix(value * np.uint64(0x9E3779B97F4A7C15) + padded[begin + k])
        value = step if k == 0 else np.where(k < length, step, value)
    value ^= length.astype(np.uint64)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples (rows x SAMPLES, uint32) of non-empty sets."""
    odd, add, *_ = _constants()
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, SAMPLES), np.uint32)
    starts = offsets[:-1]
    for j in range(SAMPLES):
        x = (low ^ add[j]) * odd[j]
        x ^= x >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(x, starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    _, _, picks, salt, *_ = _constants()
    out = np.empty((len(samples), BANDS), np.int64)
    for b in range(BANDS):
        key = np.full(len(samples), b, np.uint64)
        for r in range(ROWS):
            key = mix(key + samples[:, picks[b, r]] * salt[b, r])
        out[:, b] = key.view(np.int64)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x BITS/64, uint64)."""
    spot = _constants()[4]
    place = mix(samples.astype(np.uint64) ^ spot) & np.uint64(BITS - 1)
    flips = np.zeros((len(samples), BITS), np.uint8)
    row = np.arange(len(samples))
    for j in range(samples.shape[1]):
        flips[row, place[:, j].astype(np.int64)] ^= 1
    return np.packbits(flips, axis=1).view(np.uint64)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity told by the population count of the XOR of two sketches."""
    share = np.minimum(2 * differing / BITS, 1 - 1e-3)
    return 1 + BITS / (4 * SAMPLES) * np.log(1 - share)


def _sketched(batches) -> Iterator[pa.RecordBatch]:
    for batch, raw, ends in parts(batches):
        values, offsets = shingle_sets(raw, ends)
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        h = np.zeros((2, len(n)), np.int64)
        keys: list = [None] * len(n)
        sketches: list = [None] * len(n)
        if len(full):
            starts = offsets[:-1][full]
            samples = signatures(values, np.append(starts, len(values)))
            h[0, full] = np.add.reduceat(mix(values), starts).view(np.int64)
            h[1, full] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts).view(np.int64)
            bands, odd = band_keys(samples), odd_sketches(samples)
            for k, at in enumerate(full):
                keys[at], sketches[at] = bands[k].tobytes(), odd[k].tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(h[0]), pa.array(h[1]), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
            names=["doc_id", "row", "n", "h1", "h2", "keys", "sketch"],
        )


def _exploded(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 1000):
            some = batch.slice(lo, 1000)
            keys = np.frombuffer(b"".join(some.column("keys").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(some.column("cls").to_numpy(), BANDS))], names=["band", "cls"])


def _within(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair for each join of clusters among the classes of one task's share of a key.

    Clusters start as the groups that are known; classes whose sketches are near join them. There are
    fewer pairs than classes.
    """
    pdf = pdf.drop_duplicates(["cls", "sketch"]).sort_values(["cls", "sketch"], kind="stable")
    ids = pdf["cls"].to_numpy(np.int64)
    sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(ids), -1)
    cluster = np.unique(pdf["known"].to_numpy(np.int64), return_inverse=True)[1]
    same, pairs = np.zeros(len(ids), bool), []
    for k in range(len(ids)):
        if same[k]:  # nearly equal to one that has been compared with all; the blocks compare it
            continue
        near = estimate(np.bitwise_count(sketch ^ sketch[k]).sum(1, dtype=np.int64))
        same |= near >= SAME
        sure = np.flatnonzero((near >= NEAR) & (cluster != cluster[k]))
        sure = sure[np.argsort(-near[sure], kind="stable")]
        pairs += [(ids[k], ids[j]) for j in sure[np.unique(cluster[sure], return_index=True)[1]]]
        cluster[np.isin(cluster, cluster[sure])] = cluster[k]
    return pd.DataFrame({"a": np.array([min(p) for p in pairs], np.int64), "b": np.array([max(p) for p in pairs], np.int64)})


def _likely(large: DataFrame, known: DataFrame, turn: int) -> DataFrame:
    """Likely pairs of classes in different known groups, by tasks of about CHUNK classes; one key for each class."""
    spot = F.xxhash64("band", F.lit(turn))
    own = large.groupBy("cls").agg(F.min_by("band", F.struct(spot, F.col("band"))).alias("band"))
    rows = own.join(known, "cls")
    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / CHUNK).alias("share"), F.min("known").alias("lo"), F.max("known").alias("hi")).filter("lo < hi").select("band", "share")
    part = F.pmod(F.xxhash64("cls", F.lit(turn)), F.col("share"))
    dealt = rows.join(sizes, "band").select("band", part.alias("part"), "cls", "sketch", "known")
    return dealt.groupBy("band", "part").applyInPandas(_within, "a long, b long")


def blocks(rows: DataFrame) -> DataFrame:
    """(key, i, j, share, cls, ...): every two classes of a key with different ``known`` groups are in one
    block (key, i, j), of one share (i = j) or of two. rows: key, cls, known, size, and more that is kept.

    Classes are dealt to shares of about CHUNK, and of about SHINGLES shingles, those of a long key's
    largest group apart from the others, as they need not meet each other.
    """
    counts = rows.groupBy("key", "known").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    sizes = counts.groupBy("key").agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.max(F.struct("c", "known", "s")).alias("top")).filter("n > top.c")
    shares = lambda c, s: F.ceil(F.greatest(c / CHUNK, s / SHINGLES))
    long = shares(F.col("n"), F.col("s")) > 1
    sizes = saved(
        sizes.select(
            "key", F.when(long, F.col("top.known")).alias("top"), F.when(long, shares(F.col("n") - F.col("top.c"), F.col("s") - F.col("top.s"))).otherwise(1).alias("others"),
            F.when(long, shares(F.col("top.c"), F.col("top.s"))).otherwise(0).alias("tops"),
        ),
        "key-shares",
    )
    spot, own = F.xxhash64("cls", F.lit("share")), F.col("known") == F.col("top")
    more = [c for c in rows.columns if c not in ("key", "size")]
    dealt = rows.join(sizes, "key").select(
        "key", *more, F.when(own, F.col("others") + F.pmod(spot, F.col("tops"))).otherwise(F.pmod(spot, F.col("others"))).alias("share"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1 + F.when(own, 0).otherwise(F.col("tops")))).alias("with"),
    )
    return dealt.select("key", F.least("share", "with").alias("i"), F.greatest("share", "with").alias("j"), "share", *more)


def _block(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Ids, sketches and groups of a block, its first share before the other; classes k < stop meet those
    from max(k + 1, start) on."""
    ids, sketch = pdf["cls"].to_numpy(np.int64), np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
    if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
        return ids, sketch, pdf["known"].to_numpy(np.int64), len(ids), 0
    n = int((pdf["share"] == pdf["i"]).sum())
    return ids, sketch, pdf["known"].to_numpy(np.int64), n, n


def _before(pdf: pd.DataFrame) -> np.ndarray:
    """The keys that a block's classes have in the bands before that of the block's own key.

    Classes that agree in one of these meet there: its key is of many classes, or gives all its pairs.
    """
    keys = np.frombuffer(b"".join(pdf["keys"]), np.int64).reshape(len(pdf), -1)
    own = np.flatnonzero((keys == pdf["key"].iloc[0]).any(0))
    return keys[:, : own[0] if len(own) else 0]


@lru_cache(maxsize=1)
def _far() -> int:
    """Most differing bits of sketches whose estimate is at least CUT."""
    return int(np.count_nonzero(estimate(np.arange(BITS // 2)) >= CUT)) - 1


_UNSURE = ["a", "b", "key", "i", "j", "share", "known", "sketch", "keys"]


def _unsure(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of a block that pass, or, where there are more than PAIRS for each class, the classes (a) in them."""
    pdf = pdf.drop_duplicates(["cls", "sketch", "share"]).sort_values(["share", "cls"], kind="stable")
    ids, sketch, known, stop, start = _block(pdf)
    before = _before(pdf)
    first, second, total = [], [], 0
    held = np.zeros(len(ids), bool)
    for k in range(stop):
        lo = max(k + 1, start)
        near = np.bitwise_count(sketch[lo:] ^ sketch[k]).sum(1, dtype=np.int64) <= _far()
        met = lo + np.flatnonzero(near & (known[lo:] != known[k]))
        met = met[~(before[met] == before[k]).any(1)]
        if len(met):
            total += len(met)
            held[k] = True
            held[met] = True
            if total <= PAIRS * len(ids):
                first.append(np.full(len(met), ids[k]))
                second.append(ids[met])
    key, i, j = (int(pdf[c].iloc[0]) for c in ("key", "i", "j"))
    if total > PAIRS * len(ids):
        own = pdf[held].rename(columns={"cls": "a"})
        return own.assign(b=pd.array([pd.NA] * len(own), "Int64"))[_UNSURE]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second))
    out = pd.DataFrame({"a": np.minimum(a, b), "b": pd.array(np.maximum(a, b), "Int64"), "key": key, "i": i, "j": j, "share": 0, "known": 0})
    return out.assign(sketch=None, keys=None)[_UNSURE]


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a block, confirmed on the full sets: as many as join all that its links join."""
    pdf = pdf.sort_values(["share", "cls"], kind="stable")
    ids, sketch, known, stop, start = _block(pdf)
    before = _before(pdf)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["own"]]
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.zeros(int(number.max(initial=0)) + 1, bool)
    cluster, pairs = np.unique(known, return_inverse=True)[1], []
    for k in range(stop):
        lo = max(k + 1, start)
        met = lo + np.flatnonzero((cluster[lo:] != cluster[k]) & (np.bitwise_count(sketch[lo:] ^ sketch[k]).sum(1, dtype=np.int64) <= _far()))
        met = met[~(before[met] == before[k]).any(1)]
        if not len(met):
            continue
        own = number[at[k] : at[k + 1]]
        held[own] = True
        n = size[met]
        begin = np.cumsum(n) - n
        both = np.add.reduceat(held[number[np.repeat(at[met] - begin, n) + np.arange(n.sum())]], begin, dtype=np.int64)
        held[own] = False
        for j in met[100 * both >= 75 * (size[k] + n - both)]:
            if cluster[j] != cluster[k]:
                pairs.append((ids[k], ids[j]))
                cluster[cluster == cluster[j]] = cluster[k]
    return pd.DataFrame({"a": np.array([min(p) for p in pairs], np.int64), "b": np.array([max(p) for p in pairs], np.int64)})


def shared_keys(classes: DataFrame) -> DataFrame:
    """(band, cls, n): keys that n > 1 classes have. classes: cls, keys, sketch."""
    bands = classes.select("cls", "keys").mapInArrow(_exploded, "band long, cls long")
    counts = saved(bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "key-counts")
    return saved(bands.join(counts, "band"), "keys-met")


def links_of_many(met: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links of keys with many classes; they join all that any two classes of a key that pass do.

    Clustering passes find most links with few pairs; each starts from the groups that the links found
    so far make. Then all classes of a key that are still in different groups meet in blocks.
    """
    links = texts.sparkSession.createDataFrame([], "a long, b long")
    tried, large = links, met.filter(F.col("n") > FEW).select("band", "cls")
    groups = links.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def known_now(*more: str) -> DataFrame:
        known = sketches.join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        return known.select("cls", "sketch", "size", F.coalesce("component", "cls").alias("known"), *more)

    for turn in range(PASSES):
        pairs = _likely(large, saved(known_now(), "known"), turn).filter("a < b").distinct()
        pairs = saved(pairs.join(tried, ["a", "b"], "left_anti"), "pairs-many")
        new = saved(confirmed(pairs, texts), "links-new")
        links, tried = links.unionByName(new), tried.unionByName(pairs)
        if not new.limit(1).count():
            break
        groups = components(links)
    # one join gives the rows of all keys; what a class has goes with them from here on
    rows = saved(large.join(known_now("keys"), "cls").withColumnRenamed("band", "key"), "keys-known")
    found = saved(blocks(rows).groupBy("key", "i", "j").applyInPandas(_unsure, "a long, b long, key long, i long, j long, share long, known long, sketch binary, keys binary"), "unsure")
    pairs = saved(found.filter("a < b").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs-unsure")
    links = links.unionByName(saved(confirmed(pairs, texts), "links-unsure"))
    full = found.filter("b is null").drop("b").withColumnRenamed("a", "cls")
    if not full.limit(1).count():
        return links
    sets = saved(full_sets(full.select(F.col("cls").alias("doc_id")).distinct(), texts), "sets")
    whole = full.join(sets, "cls")
    return links.unionByName(saved(whole.groupBy("key", "i", "j").applyInPandas(_linked, "a long, b long").filter("a < b").distinct(), "links-blocks"))


def pairs_of_few(met: DataFrame, sketches: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b, of keys with few classes, for classes that are not in one group
    (node, component) already."""
    rows = met.filter(F.col("n") <= FEW).join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    own = F.struct("cls", F.coalesce("component", "cls").alias("group"))
    few = rows.groupBy("band").agg(F.array_sort(F.collect_set(own)).alias("c"), F.min(own["group"]).alias("lo"), F.max(own["group"]).alias("hi"))
    first = few.filter("lo < hi").select("c", F.posexplode("c").alias("i", "x"))
    later = F.filter(F.slice("c", F.col("i") + 2, F.size("c")), lambda y: y["group"] != F.col("x.group"))
    pairs = first.select(F.col("x.cls").alias("a"), F.explode(F.transform(later, lambda y: y["cls"])).alias("b")).distinct()
    passed = (
        pairs.join(sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a")
        .join(sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b")
        .mapInArrow(_pass, "a long, b long")
    )
    return saved(passed.filter("a < b").distinct(), "pairs-few")


def _pass(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(batch), -1) for c in ("x", "y"))
        near = estimate(np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) >= CUT
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _sets(batches) -> Iterator[pa.RecordBatch]:
    for batch, raw, ends in parts(batches):
        values, at = shingle_sets(raw, ends)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["cls", "own"])


def _confirm(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, own): the sets of the texts of ``ids`` (doc_id); an id with several texts has several."""
    ids = saved(ids, "ids-met")
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)  # at most 8 bytes for each of SENT_IDS; beyond that the texts are moved
    return docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(_sets, "cls long, own binary")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough; only texts of documents in pairs are read into sets."""
    # an id with several texts is linked if one of them is
    sets = saved(full_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), docs), "sets")
    return (
        pairs.join(sets.select(F.col("cls").alias("a"), F.col("own").alias("x")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("own").alias("y")), "b")
        .mapInArrow(_confirm, "a long, b long")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, row (its ``row_key``), n_shingles, component_id, kept."""
    rows = plain(docs, "doc_id", "text").select("doc_id", "text", row_key().alias("row"))
    sketched = saved(rows.mapInArrow(_sketched, "doc_id long, row long, n long, h1 long, h2 long, keys binary, sketch binary"), "sketches")
    small = sketched.select("doc_id", "row", "n", "h1", "h2")
    full = small.filter("n > 0")
    kinds = saved(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("cls")).filter("cls is not null"), "classes")
    reps = kinds.select("h1", "h2", F.col("n").alias("m"), "cls")
    classes = sketched.join(reps, (sketched.doc_id == reps.cls) & (sketched.h1 == reps.h1) & (sketched.h2 == reps.h2), "left_semi").select(F.col("doc_id").alias("cls"), "keys", "sketch", F.col("n").alias("size")).dropDuplicates(["cls", "sketch"])
    texts, sketches = rows.select("doc_id", "text").filter("doc_id is not null"), classes.select("cls", "keys", "sketch", "size")
    met = shared_keys(classes)
    sure = links_of_many(met, sketches, texts)
    links = sure.unionByName(confirmed(pairs_of_few(met, sketches, components(sure)), texts))
    # an id that has several texts ties their classes together
    member = full.filter("doc_id is not null").join(kinds, ["h1", "h2", "n"]).select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))
    groups = saved(components(links.unionByName(member.filter("a <> b"))), "components")
    out = small.join(kinds, ["h1", "h2", "n"], "left").select("doc_id", "row", "n", F.coalesce("doc_id", "cls").alias("node"))
    named = out.join(groups, "node", "left").select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    return named.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """(row): keys of the rows to keep, one of each group; of rows that share the least id, one."""
    found = near_duplicates(docs)
    # rows without words, and groups without any id, are told apart by their text
    group = F.struct("component_id", F.when(F.col("component_id").isNull() | (F.col("n_shingles") == 0), F.col("row")))
    first = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("later"), "doc_id", "row")).alias("first"))
    return first.select("first.row").distinct()
