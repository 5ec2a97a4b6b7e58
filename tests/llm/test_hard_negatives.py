"""Hard negatives against a search over all rows."""

import math

import numpy as np
import pytest

from tankline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10):
    use = []
    for vec_id, x, label in {(i, None if v is None else tuple(v), lab) for i, v, lab in rows}:
        if vec_id is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            use.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = []
    for a in use:
        if a[0] % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[2], r[2])), r[0], r[1]) for r in use if r is not a and len(r[2]) == len(a[2]))
        for s, pid, _ in [x for x in scored if x[2] == a[1]][:positives]:
            window = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a[0], pid, k, nid, -s, -n) for k, (n, nid, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, parts=3):
    return sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()))


def random_rows(n, d, seed, spread=1.0):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(0, spread, (10, d))
    return [(i, (centre[i % 10] + rnd.normal(0, 0.7, d)).astype(np.float32).tolist(), int(rnd.integers(0, 10)) if i % 5 == 0 else i % 10) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "first"), [(700, 8, 2), (400, 3, 1), (300, 32, 64)])
def test_equals_brute_force(spark, monkeypatch, n, d, first):
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives, "SHARD", 150)
    monkeypatch.setattr(hard_negatives, "GROUP", 2)
    rows = random_rows(n, d, seed=d)
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 50


def test_ties_are_broken_by_id(spark):
    # few different vectors, so most scores are equal
    rows = [(i, [float(i % 3), 1.0], i % 2) for i in range(450)]
    assert mined(spark, rows) == brute(rows)


def test_stops_early():
    """A query whose best rows stand out does not read whole lists."""
    rnd = np.random.default_rng(1)
    x = rnd.integers(-20, 20, (5000, 6))
    x[:50] = 500 + rnd.integers(0, 20, (50, 6))
    n = len(x)
    shard = hard_negatives.Shard(np.arange(n), np.arange(n), np.zeros(n, np.int32), x)
    reads = []

    class Watched(np.ndarray):
        def astype(self, *args, **kwargs):
            reads.append(len(self))
            return np.asarray(self).astype(*args, **kwargs)

    shard.whole = x[np.lexsort((np.arange(n),))].view(Watched)
    [(place, score)] = shard.search(-1, 0, np.full(6, 3), np.array([0]), np.array([1 << 40]), 10, True)
    assert score.tolist() == sorted((3 * x.sum(1)).tolist(), reverse=True)[:10]
    assert sum(reads) < n / 2


def test_nulls_and_rows_that_take_no_part(spark):
    rows = random_rows(320, 4, seed=9)
    odd = [(500, None, 1), (501, [1.0, None, 2.0, 3.0], 1), (600, [float("nan")] * 4, 2), (601, [float("inf"), 0.0, 0.0, 0.0], 2), (602, [1.0] * 4, None), (None, [1.0] * 4, 3), (603, [1.0, 2.0], 3), (700, [0.0] * 4, 0), (800, [-1.0] * 4, 4), (900, [], 1)]
    assert mined(spark, rows + odd) == brute(rows + odd)


def test_equal_rows_count_once(spark):
    rows = random_rows(300, 4, seed=4)
    assert mined(spark, rows + rows[:150]) == mined(spark, rows)


def test_empty_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []


def test_other_columns_do_not_matter(spark):
    rows = random_rows(210, 4, seed=6)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as score", "3 as anchor", "4 as x")
    assert sorted(map(tuple, hard_negatives.mine(wide).collect())) == brute(rows)
