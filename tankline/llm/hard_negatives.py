"""Hard-negative mining with Fagin's threshold algorithm.

Scores are inner products of integer vectors. For every anchor the best rows of its own label are its
positives; for every positive, the best rows of other labels whose score lies in a window (two shares of
the positive's score) are its hard negatives.

Rows are dealt to shards of about SHARD rows, anchors to groups of about GROUP. Every shard meets every
group of anchors in one task, which runs the threshold algorithm for each anchor:

- each dimension has the list of the shard's rows in the order of that component; an anchor goes down the
  list where its own component is positive and up where it is negative (zero components are left out),
- rows met in any list are scored on all components (random access), each once,
- the threshold is the score that a row not met so far can have at most: the sum over the dimensions of
  the anchor's component times the last one met in its list,
- an anchor is done when the threshold is strictly below the k-th score that it has so far in each of its
  windows, or below a window's lower end, so that no row in the window, nor a tie, is unmet.

Lists are read in steps that double. What the shards give, at most k rows for each window, is merged by
a ranking that keeps k for each window in every task before the exchange. First all positives are
found, then the windows they make.

Rows with a NULL id, label or vector, or a vector with a NULL, NaN or infinite component, take no part;
vectors of another length than an anchor's have no score with it. Rows that repeat an id are rows each, also
as anchors (equal ones give equal results, once), except that rows equal in id, label and vector count as one;
ties of score and id go by the label, then the vector's hash. A positive score of zero or less has the window
that the two inequalities leave: for a negative one, none. An empty table, or one without anchors, gives no
rows. Columns other than those named are not looked at. Scores are exact where they fit in 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship

SHARD, GROUP = 16_384, 2_048  # rows of a shard, anchors that meet it in one task
FIRST = 64  # rows of each list that are read at first

_HIT = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("score", pa.int64())])
_HIT_SQL = "anchor long, window long, row long, vec_id long, label int, score long"


def integer_rows(vectors: DataFrame, relabel_every: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, x): the rows that take part, with floor(scale * component), and the labels of every
    ``relabel_every``-th id moved on by one. ``row`` is a hash of the three."""
    ship(vectors.sparkSession)
    parts = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), parts.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    moved = F.when(F.pmod("vec_id", F.lit(relabel_every)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    whole = rows.select("vec_id", moved.alias("label"), F.transform("x", lambda v: F.floor(v * scale)).alias("x"))
    return whole.select(F.xxhash64("vec_id", "label", "x").alias("row"), "*").dropDuplicates(["row", "vec_id", "label", "x"])


class Shard:
    """Rows of one length, with their list for each dimension."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = np.lexsort((row, label, vec_id))  # among equal scores the first place counts
        self.row, self.vec_id, self.label, x = row[order], vec_id[order], label[order], x[order]
        self.whole = x
        self.lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)  # dimension x rank, ascending
        self.sorted = np.take_along_axis(x.T, self.lists, axis=1)
        self.size = int(np.abs(x).max(initial=0))

    def search(self, anchor: int, label: int, a: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window low <= score <= high: places and scores of the first k rows (of the same label, or of others), best first."""
        n = len(self.row)
        used = np.flatnonzero(a)
        down = a[used] > 0
        exact = len(a) * self.size * int(np.abs(a).max(initial=0)) < 2**53
        mine = a.astype(np.float64) if exact else a
        right = (self.label == label) & (self.row != anchor) if same else self.label != label
        met, done = np.zeros(n, bool), 0
        place, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = FIRST if len(used) else n
        while True:
            depth = min(depth, n)
            fresh = np.zeros(n, bool)
            if depth == n:
                fresh[:] = True
            else:
                fresh[self.lists[used[down], n - depth : n - done]] = True
                fresh[self.lists[used[~down], done:depth]] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh & right)
            got = (self.whole[new].astype(mine.dtype) @ mine).astype(np.int64)
            place, score = np.concatenate([place, new]), np.concatenate([score, got])
            order = np.lexsort((place, -score))
            place, score = place[order], score[order]
            # windows are stretches of the descending scores
            begin, end = np.searchsorted(-score, -high, "left"), np.searchsorted(-score, -low, "right")
            if depth == n:
                break
            last = np.where(down, self.sorted[used, n - depth], self.sorted[used, depth - 1])
            threshold = sum(int(p) * int(q) for p, q in zip(a[used], last))
            # done where the threshold is strictly below the k-th score of the window, or below the window
            kth = np.where(end - begin >= k, score[np.minimum(begin + k - 1, max(len(score) - 1, 0))] if len(score) else low, low)
            if ((threshold < np.maximum(kth, low)) | (low > high)).all():
                break
            done, depth = depth, 2 * depth
        return [(place[b : min(e, b + k)], score[b : min(e, b + k)]) for b, e in zip(begin.tolist(), end.tolist())]


def _meet(k: int, same: bool):
    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows) and len(anchors):
            wide = rows.column("x").combine_chunks()
            shard = Shard(*(rows.column(c).to_numpy() for c in ("row", "vec_id", "label")), wide.flatten().to_numpy().astype(np.int64).reshape(len(rows), -1))
            for r in anchors.to_pylist():
                low, high = np.array(r["low"], np.int64), np.array(r["high"], np.int64)
                found = shard.search(r["anchor"], r["label"], np.array(r["x"], np.int64), low, high, k, same)
                for w, (at, score) in zip(r["window"], found):
                    out += zip([r["anchor"]] * len(at), [w] * len(at), shard.row[at].tolist(), shard.vec_id[at].tolist(), shard.label[at].tolist(), score.tolist())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _HIT.types)], schema=_HIT) if out else _HIT.empty_table()

    return run


def best_in_windows(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, window, rank, row, vec_id, label, score): of the rows of the anchor's label, or of other labels, the
    first k whose scores lie in a window. rows: as from ``integer_rows``. anchors: anchor (its row), label, x,
    and arrays window, low, high."""
    shards = max(1, -(-rows.count() // SHARD))
    groups = max(1, -(-anchors.count() // GROUP))
    spot = [F.size("x").alias("d"), F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(shards)).alias("shard")]
    left = anchors.select("anchor", "label", "x", "window", "low", "high", F.size("x").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64(F.lit(5), "anchor"), F.lit(groups)).alias("part"))
    right = rows.select("row", "vec_id", "label", "x", *spot, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"))
    keys = ("d", "shard", "part")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k, same), _HIT_SQL)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "label", "row")
    return hits.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Per anchor, positive and hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives satisfy low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    rows = saved(integer_rows(vectors), "vectors")
    all_ = F.array(F.lit(0).cast("long")), F.array(F.lit(-(2**62)).cast("long")), F.array(F.lit(2**62).cast("long"))
    anchors = saved(rows.filter(F.pmod("vec_id", F.lit(anchor_every)) == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "x", *(c.alias(n) for c, n in zip(all_, ("window", "low", "high")))), "anchors")
    found = saved(best_in_windows(rows, anchors, positives, same=True), "positives")
    # a window for each positive, by its rank: whole scores between the two shares
    ends = F.struct(F.col("rank").cast("long").alias("window"), F.ceil(_share(low)).cast("long").alias("low"), F.floor(_share(high)).cast("long").alias("high"))
    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(ends)).alias("w")).select("anchor", F.col("w.window").alias("window"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    asked = anchors.drop("window", "low", "high").join(windows, "anchor")
    hits = best_in_windows(rows, saved(asked, "windows"), negatives, same=False)
    pairs = found.select("anchor", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = pairs.join(anchors.select("anchor", "anchor_id"), "anchor")
    return hits.join(own, ["anchor", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _share(percent: int) -> Column:
    return F.col("score").cast("decimal(20,0)") * percent / 100


#: the same as one statement for DuckDB
SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda v: cast(floor(256 * cast(v as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
), scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, r.vec_id, r.label,
    cast(list_inner_product(cast(a.x as double[]), cast(r.x as double[])) as bigint) as score
  from rows a, rows r where a.vec_id % 100 = 0 and r.vec_id <> a.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score,
    row_number() over (partition by anchor_id order by score desc, vec_id) as place
  from scored where label = anchor_label
  qualify place <= 5
)
select p.anchor_id, p.positive_id,
  cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
  and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
"""
