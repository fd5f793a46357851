"""Property test: split quotas equal a plain-Python statement of the size rule."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from sardonyx import config as C
from sardonyx.operators.ranking import split_quotas


def _apportion(counts: dict[int, int], draws: int, total: int) -> dict[int, int]:
    share = {k: (n * draws) / total if total else 0.0 for k, n in counts.items()}
    floor = {k: math.floor(v) for k, v in share.items()}
    need = draws - sum(floor.values())
    order = sorted(counts, key=lambda k: (-(share[k] - floor[k]), k))
    return {k: floor[k] + (1 if i < need else 0) for i, k in enumerate(order)}


def _expected(counts: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    n = sum(counts.values())
    rest_total = n - math.ceil(C.TEST_SPLIT * n)
    rest = _apportion(counts, rest_total, n)
    train_total = rest_total - math.ceil(C.VAL_OF_REST * rest_total)
    train = _apportion(rest, train_total, rest_total)
    return {k: (counts[k] - rest[k], rest[k] - train[k], train[k]) for k in counts}


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(0, 6), st.integers(2, 5000), min_size=1, max_size=4))
def test_quotas_match_rule(spark, counts):
    df = spark.createDataFrame(sorted(counts.items()), "label int, n bigint")
    got = {r["label"]: (r["n_test"], r["n_val"], r["n_train"]) for r in split_quotas(df).collect()}
    assert got == _expected(counts)
    n = sum(counts.values())
    assert sum(v[0] for v in got.values()) == math.ceil(C.TEST_SPLIT * n)


def test_quotas_of_huge_classes(spark):
    sizes = spark.createDataFrame([(0, 50_000_000_000), (1, 30_000_000_001)], "label int, n bigint")
    got = {r["label"]: r for r in split_quotas(sizes).collect()}
    assert sum(r["n_test"] for r in got.values()) == math.ceil(0.05 * 80_000_000_001)
    for r in got.values():
        assert r["n_test"] + r["n_val"] + r["n_train"] == r["n"] and abs(r["n_test"] / r["n"] - 0.05) < 1e-6
