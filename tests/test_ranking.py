"""Exact class caps, split quotas and ranks that do not depend on partitioning."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sardonyx.functions.text import row_key
from sardonyx.operators.ranking import class_cap, dense_ids, split_quotas, stratified_split, two_level_rank


def _frame(spark, ones, zeros, parts=8):
    rows = [(i, 1) for i in range(ones)] + [(ones + i, 0) for i in range(zeros)]
    df = spark.createDataFrame(rows, "id bigint, label int").repartition(parts)
    return df.withColumn("row_key", row_key(F.lit("t"), F.col("id")))


@pytest.mark.parametrize("ones,zeros,test,val,train,t1,t0", [
    (100, 100, 10, 20, 170, 5, 5),
    (60, 40, 5, 10, 85, 3, 2),
    (341, 58, 20, 40, 339, 17, 3),
])
def test_split_sizes(spark, ones, zeros, test, val, train, t1, t0):
    d = stratified_split(_frame(spark, ones, zeros))
    sizes = {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    assert sizes == {"test": test, "val": val, "train": train}
    per = {(r["split"], r["label"]): r["count"] for r in d.groupBy("split", "label").count().collect()}
    assert per[("test", 1)] == t1 and per[("test", 0)] == t0


def test_quota_table_matches_sizes(spark):
    q = split_quotas(spark.createDataFrame([(1, 341), (0, 58)], "label int, n bigint"))
    got = {r["label"]: (r["n_test"], r["n_val"], r["n_train"]) for r in q.collect()}
    assert sum(v[0] for v in got.values()) == 20
    assert sum(v[1] for v in got.values()) == 40
    assert sum(v[2] for v in got.values()) == 339


def test_two_level_rank_equals_row_number(spark):
    df = _frame(spark, 341, 58)
    ranked = two_level_rank(df, ["label"], "row_key", "rk", hex_digits=2)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("row_key")) - 1)
    j = ranked.join(plain, ["id"]).filter(F.col("rk") != F.col("rn"))
    assert j.count() == 0


def test_same_result_for_1_and_64_partitions(spark):
    a = stratified_split(_frame(spark, 341, 58, parts=1)).select("id", "split")
    b = stratified_split(_frame(spark, 341, 58, parts=64)).select("id", "split")
    assert sorted(a.collect()) == sorted(b.collect())


def test_split_is_a_partition(spark):
    d = stratified_split(_frame(spark, 120, 33))
    assert d.filter(F.col("split").isNull()).count() == 0
    assert d.count() == 153


def test_class_cap_exact(spark):
    df = _frame(spark, 341, 58).withColumn("label", F.col("label").cast("double"))
    capped = class_cap(df, "label", max_samples=200, classes=(1.0, 0.0))
    got = {r["label"]: r["count"] for r in capped.filter("sampled").groupBy("label").count().collect()}
    assert got == {1.0: 100, 0.0: 58}
    # the lowest keys are the ones kept
    ones = capped.filter("label = 1.0")
    kept_max = ones.filter("sampled").agg(F.max("row_key")).first()[0]
    dropped_min = ones.filter("not sampled").agg(F.min("row_key")).first()[0]
    assert kept_max < dropped_min


def test_dense_ids_contiguous(spark):
    d = dense_ids(stratified_split(_frame(spark, 100, 50)), ["split"])
    for r in d.groupBy("split").agg(F.min("row_no").alias("lo"), F.max("row_no").alias("hi"),
                                    F.count("*").alias("n")).collect():
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1


def test_rank_with_copies_equals_row_number(spark):
    # one key held by a third of the rows (copies), spread over many partitions
    rows = [(i, 1 if i % 3 else 0, "c" * 32 if i % 3 == 0 else f"{i * 7919 % 100003:032x}")
            for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, label int, row_key string").repartition(16)
    ranked = two_level_rank(df, ["label"], "row_key", "rk", unique_keys=False)
    got = sorted((r["label"], r["row_key"], r["rk"]) for r in ranked.collect())
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("row_key")) - 1)
    exp = sorted((r["label"], r["row_key"], r["rn"]) for r in plain.collect())
    # copies are interchangeable: compare (label, key, rank) multisets
    assert got == exp


def test_split_with_copies_same_counts_for_any_partitioning(spark):
    rows = [(i, i % 2, "d" * 32 if i % 3 == 0 else f"{i:032x}") for i in range(300)]
    base = spark.createDataFrame(rows, "id bigint, label int, row_key string")
    a = stratified_split(base.repartition(1), unique_keys=False)
    b = stratified_split(base.repartition(32), unique_keys=False)
    ca = sorted(tuple(r) for r in a.groupBy("split", "label", "row_key").count().collect())
    cb = sorted(tuple(r) for r in b.groupBy("split", "label", "row_key").count().collect())
    assert ca == cb


def test_scratch_scope_deletes_unkept_tables(spark):
    import os
    from sardonyx.session import scratch_scope, write_table
    df = spark.range(10)
    with scratch_scope(spark) as scope:
        tmp = write_table(df, "tmp")
        kept = scope.keep(write_table(spark.read.parquet(tmp).selectExpr("id * 2 AS x"), "kept"))
        assert os.path.exists(tmp.replace("file:", ""))
    assert spark.read.parquet(kept).count() == 10
    assert not os.path.exists(tmp.replace("file:", ""))


def test_cluster_conf_sizes_partitions_to_input():
    from sardonyx.session import cluster_conf
    conf = cluster_conf(100 * 10**12)                       # 100 TB
    assert int(conf["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))
    assert conf["spark.sql.adaptive.enabled"] == "true"
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(cluster_conf(10)["spark.sql.shuffle.partitions"]) == 200   # floor for small inputs


@pytest.mark.parametrize("flag", [stratified_split, lambda d, **a: class_cap(d, "label", 20, **a)])
def test_rows_of_a_class_stay_in_their_partitions(spark, tmp_path, flag):
    """The cut-off keys go to the rows: no class is gathered in one task, whatever the planner's estimates."""
    _frame(spark, 60, 0, parts=4).write.parquet(str(tmp_path / "rows"))
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        rows = spark.read.parquet(str(tmp_path / "rows"))
        parts = rows.rdd.getNumPartitions()
        out = flag(rows, materialize_input=False).withColumn("p", F.spark_partition_id()).collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert parts > 1 and len(out) == 60 and len({r["p"] for r in out}) == parts
