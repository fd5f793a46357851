"""Epoch orders: bijections for every size, the same for any partitioning, and plain Python's numbers."""

import math

import pytest
from pyspark.sql import functions as F

from sardonyx.operators import permutation as P


def plain(x, n, epoch, seed=42):
    a = math.isqrt(n)
    b = n // a
    for w in range(P.WINDOWS):
        at = 0 if w % 2 == 0 else n - a * b
        if not 0 <= x - at < a * b:
            continue
        left, right = divmod(x - at, b)
        for h in range(P.HALF_ROUNDS):
            key = epoch * 362_437 + P.round_key(seed, w * P.HALF_ROUNDS + h)
            t = ((left if h % 2 else right) * P.MULTIPLIER + key) % P.LARGE_PRIME % P.SMALL_PRIME
            t = t * t % P.LARGE_PRIME
            if h % 2:
                right = (right + t) % b
            else:
                left = (left + t) % a
        x = left * b + right + at
    return x


@pytest.mark.parametrize("sizes", [[1, 2, 3, 4, 5, 7, 12, 97, 1000, 1023], [10_007]])
def test_every_epoch_is_a_bijection(spark, sizes):
    for n in sizes:
        d = spark.range(n).select(F.col("id").alias("row_no"), F.lit(n).alias("n"))
        d = d.withColumn("epoch", F.explode(F.array(F.lit(1), F.lit(2), F.lit(9))))
        got = {(r["epoch"], r["row_no"]): r["position"]
               for r in P.epoch_position(d.repartition(3), "n", "epoch").collect()}
        for e in (1, 2, 9):
            order = [got[e, i] for i in range(n)]
            assert sorted(order) == list(range(n))
            assert order == [plain(i, n, e) for i in range(n)]
        if n > 90:
            first, second = ([got[e, i] for i in range(n)] for e in (1, 2))
            assert sum(a == b for a, b in zip(first, second)) < n / 20
            # neighbours are torn apart, and the numbers left over by the digits move as well
            assert sum(abs(first[i] - first[i + 1]) <= 2 for i in range(n - 1)) < n / 10
            assert sum(first[i] == i for i in range(n)) < n / 20


def test_spread_over_batches():
    """Rows of one batch of the old order meet in few of the new batches, and positions are even."""
    n, size = 100_000, 32
    cells = [0] * 100
    for i in range(0, 3000):
        cells[plain(i, n, 3) * 100 // n] += 1
    assert max(cells) < 75 and min(cells) > 6
    together = sum(len({plain(s * size + k, n, 1) // size for k in range(size)}) for s in range(100))
    assert together > 100 * size * 0.97


def test_large_sizes_do_not_overflow(spark):
    n = 10 ** 13 + 37
    rows = [0, 1, n // 2, n - 1, n - 2, n - 3]
    d = spark.createDataFrame([(i, n, 4) for i in rows], "row_no bigint, n bigint, epoch int")
    got = {r["row_no"]: r["position"] for r in P.epoch_position(d, "n", "epoch").collect()}
    assert got == {i: plain(i, n, 4) for i in rows} and len(set(got.values())) == len(rows)


def test_epoch_minibatches_keep_other_splits_in_order(spark):
    rows = [("train", i, 70) for i in range(70)] + [("val", i, 130) for i in range(130)] + [("train", None, 70)]
    d = spark.createDataFrame(rows, "split string, row_no bigint, n bigint")
    out = P.epoch_minibatches(d, 3).where("row_no is not null").collect()
    for e in (1, 2, 3):
        train = {r["position"]: r for r in out if r["epoch"] == e and r["split"] == "train"}
        assert sorted(train) == list(range(70)) and {p // 32 for p in train} == {r["batch_id"] for r in train.values()}
        assert all(r["position"] == r["row_no"] and r["batch_id"] == r["row_no"] // 64
                   for r in out if r["epoch"] == e and r["split"] == "val")
