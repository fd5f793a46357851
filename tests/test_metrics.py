"""Metric operators on hand-checked cases (AUC, histogram, confusion, per-domain accuracy, losses)."""

import math

import pytest
from pyspark.sql import functions as F

from sardonyx.operators import metrics as MX
from sardonyx.operators.losses import batch_mean_loss, head_losses


def _scored(spark, labels, scores):
    rows = [(int(y), float(s), int(s > 0.5)) for y, s in zip(labels, scores)]
    return spark.createDataFrame(rows, "label int, score double, pred int")


@pytest.mark.parametrize("labels,scores,auc", [
    ([1, 0], [0.5, 0.5], 0.5),
    ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75),
])
def test_auc_cases(spark, labels, scores, auc):
    assert MX.roc_auc(_scored(spark, labels, scores)).first()["auc"] == pytest.approx(auc)


def test_auc_equals_rank_sum(spark):
    import random
    rnd = random.Random(7)
    labels = [rnd.randint(0, 1) for _ in range(300)]
    scores = [round(rnd.random(), 2) for _ in range(300)]   # many ties
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    got = MX.roc_auc(_scored(spark, labels, scores), buckets=16).first()["auc"]
    assert got == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-6)


def test_roc_drops_collinear_points(spark):
    # sklearn: y=[0,0,1,1], s=[.1,.4,.35,.8] -> fpr [0,0,.5,.5,1], tpr [0,.5,.5,1,1]
    pts = MX.roc_points(_scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])).collect()
    curve = sorted((r["fpr"], r["tpr"]) for r in pts)
    assert curve == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    assert any(math.isinf(r["threshold"]) for r in pts)


def test_roc_two_level_matches_one_level(spark):
    import random
    rnd = random.Random(3)
    labels = [rnd.randint(0, 1) for _ in range(500)]
    scores = [rnd.random() for _ in range(500)]
    a = sorted(tuple(r) for r in MX.roc_points(_scored(spark, labels, scores), buckets=1).collect())
    b = sorted(tuple(r) for r in MX.roc_points(_scored(spark, labels, scores), buckets=4096).collect())
    assert a == b


def test_histogram_density(spark):
    h = MX.score_histogram(_scored(spark, [1, 1, 1, 1], [0.2, 0.2, 0.5, 0.9]), bins=5)
    dens = [r["density"] for r in h.orderBy("bin").collect()]
    assert dens == pytest.approx([3.571429, 0.0, 1.785714, 0.0, 1.785714], abs=1e-6)


def test_histogram_single_value_range(spark):
    h = MX.score_histogram(_scored(spark, [0, 0], [0.3, 0.3]), bins=2).orderBy("bin").collect()
    assert [(r["bin_lo"], r["bin_hi"]) for r in h] == [(-0.2, 0.3), (0.3, 0.8)]
    assert [r["n"] for r in h] == [0, 2]


def test_histogram_integrates_to_one(spark):
    import random
    rnd = random.Random(1)
    df = _scored(spark, [rnd.randint(0, 1) for _ in range(200)], [rnd.random() for _ in range(200)])
    for r in MX.score_histogram(df).groupBy("label").agg(
            F.sum(F.col("density") * (F.col("bin_hi") - F.col("bin_lo"))).alias("a")).collect():
        assert r["a"] == pytest.approx(1.0, abs=1e-4)


def test_confusion_and_report(spark):
    df = _scored(spark, [0, 0, 1, 1, 1], [0.1, 0.9, 0.8, 0.7, 0.2])
    cm = {(r["label"], r["pred"]): r["n"] for r in MX.confusion(df).collect()}
    assert cm == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    pct = {(r["label"], r["pred"]): r["pct"] for r in MX.confusion_pct(df).collect()}
    assert pct[(1, 1)] == pytest.approx(66.666667)
    acc = MX.accuracy_f1(df).first()
    assert acc["accuracy"] == pytest.approx(0.6)
    # sklearn weighted F1: class0 f1 = .5 (support 2), class1 f1 = 2/3 (support 3)
    assert acc["f1_weighted"] == pytest.approx((0.5 * 2 + (2 / 3) * 3) / 5, abs=1e-6)
    rep = {r["row_name"]: r for r in MX.classification_report(df).collect()}
    assert rep["Sarcastic"]["precision"] == pytest.approx(2 / 3, abs=1e-6)
    assert rep["accuracy"]["precision"] is None and rep["accuracy"]["support"] == 5


def test_empty_true_class_gives_null_percent(spark):
    pct = MX.confusion_pct(_scored(spark, [1, 1], [0.9, 0.1])).collect()
    assert all(r["pct"] is None for r in pct if r["label"] == 0)


def test_domain_accuracy_lists_every_domain(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (6, 0, 0)], "domain_idx int, label int, pred int")
    rows = {r["domain_idx"]: r for r in MX.domain_accuracy(df).collect()}
    assert len(rows) == 7
    assert rows[0]["accuracy"] == 0.5 and rows[0]["tier"] == "poor"
    assert rows[3]["n"] == 0 and rows[3]["accuracy"] == 0.0
    mean = MX.domain_accuracy_mean(MX.domain_accuracy(df)).first()["mean_accuracy"]
    assert mean == pytest.approx((0.5 + 1.0) / 7, abs=1e-6)


def test_tiers(spark):
    df = spark.createDataFrame([(0.80,), (0.70,), (0.6999,)], "a double")
    assert [r[0] for r in df.select(MX.tier(F.col("a"))).collect()] == ["good", "fair", "poor"]


def test_losses(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0] * 7, 1, 3)],
                               "sarcasm_logits array<double>, domain_logits array<double>, sarc_label int, domain_label int")
    r = head_losses(df).first()
    assert r["sarcasm_loss"] == pytest.approx(math.log(2))
    assert r["domain_loss"] == pytest.approx(math.log(7))
    assert r["total_loss"] == pytest.approx(0.7 * math.log(2) + 0.3 * math.log(7))


def test_mean_of_batch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, 7.0), (2, 12.0)],
                               "batch_id bigint, total_loss double")
    r = batch_mean_loss(df, cols=["total_loss"]).first()
    assert r["mean_total_loss"] == pytest.approx(20 / 3, abs=1e-6) and r["n_batches"] == 3


def test_roc_with_saturated_scores(spark):
    # a third of the rows crowd just below 1.0 with distinct values
    import random
    rnd = random.Random(11)
    labels, scores = [], []
    for i in range(600):
        y = rnd.randint(0, 1)
        labels.append(y)
        scores.append(1.0 - rnd.random() * 1e-9 if i % 3 == 0 else rnd.random())
    df = _scored(spark, labels, scores)
    b = df.select(MX.score_bucket(F.col("score"), 1024).alias("b")).groupBy("b").count()
    assert b.agg(F.max("count")).first()[0] < 200       # the crowd is spread over many buckets
    a1 = sorted(tuple(r) for r in MX.roc_points(df, buckets=1).collect())
    a2 = sorted(tuple(r) for r in MX.roc_points(df, buckets=1024).collect())
    assert a1 == a2


def test_score_bucket_monotone(spark):
    vals = [-5.0, -0.1, 0.0, 1e-300, 1e-9, 0.2, 0.5, 0.9, 1 - 1e-12, 1.0, 1.5, 1e6]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r[0] for r in df.select(MX.score_bucket(F.col("s"), 1024)).collect()]
    assert got == sorted(got)


def test_odd_labels_and_scores(spark):
    rows = [(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.9), (1, 0, 0.2), (1, 1, 0.8), (2, 0, 0.3),
            (None, 1, 0.7), (1, None, 0.7)]
    d = spark.createDataFrame(rows, "label int, pred int, score double")
    got = MX.accuracy_f1(d).first()
    assert got["n"] == 6 and got["accuracy"] == 0.5
    f0, f1 = 2 / (2 + 1 + 1 + 1), 4 / (4 + 1 + 1)
    assert abs(got["f1_weighted"] - round((2 * f0 + 3 * f1) / 6, 6)) < 1e-9
    clean = MX.roc_auc(d.filter("label IS NOT NULL")).first()
    odd = d.unionByName(spark.createDataFrame([(1, 1, None), (0, 0, float("nan"))], d.schema))
    assert MX.roc_auc(odd).first() == clean
    assert MX.roc_points(odd).filter("threshold IS NULL OR isnan(threshold)").count() == 0
