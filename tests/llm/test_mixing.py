import numpy as np
import pytest
from pyspark.sql import functions as F

from sardonyx.llm import mixing
from tests.conftest import SF_CHECK
from tests.llm.frames import DOC_SCHEMA, LABEL_SCHEMA, documents, labels


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels")]


@pytest.mark.parametrize("targets", [{}, {"weights": {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}},
                                     {"weights": {"en": 1, "de": 3, "nowhere": 5}, "max_rate": 2.0}])
def test_expected_totals_meet_the_targets(tables, targets):
    docs, known = tables
    mixer = mixing.solve(docs, known, "lang", **targets)
    rows = [(r["text"] or "").encode() for r in docs.select("text").collect()]
    t, p = mixer.memberships(rows)
    rate = mixer.rates(p)
    assert rate.min() >= 0 and rate.max() <= mixer.max_rate
    natural = t @ p
    w = (natural / t.sum()) ** mixing.TEMPER
    if "weights" in targets:
        w = np.array([targets["weights"].get(d, 0) for d in mixer.domains], float)
    w /= w.sum()
    budget = min(mixer.max_rate * natural[w > 0] / w[w > 0])
    assert np.abs((rate * t) @ p - budget * w).max() / t.sum() < 0.01


@pytest.mark.parametrize("share, weight, rate, ended", [(0.4, 0.0002, 0.8, "met"), (0.9, 0.0004, 1.0, "out of reach")])
def test_a_domain_of_a_ten_thousandth_of_the_tokens(spark, share, weight, rate, ended):
    n = F.col("id")
    docs = spark.range(4004).select(n.alias("doc_id"), F.when(n < 4, "few").otherwise("many").alias("lang"), F.when(
        n < 4, " ".join(f"few{k}" for k in range(10))).otherwise(" ".join(f"many{k}" for k in range(100))).alias("text"))
    known = docs.select("doc_id")
    tokens = 4 * 10 + 4000 * 100
    mixer = mixing.solve(docs, known, "lang", weights={"few": weight, "many": 1 - weight}, budget=share * tokens)
    _, p = mixer.memberships([r["text"].encode() for r in docs.where("doc_id < 8").select("text").collect()])
    want = [rate] * 4 + [share * tokens * (1 - weight) / 400_000] * 4
    assert np.allclose(mixer.rates(p), want, rtol=0.006) and mixer.ended == ended
    assert abs(mixer.miss["few"] - (rate * 40 / (weight * share * tokens) - 1)) < 0.006
    assert abs(mixer.miss["many"]) <= mixing.TOLERANCE


def test_overlapping_domains_go_on_until_met(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.col("id") % 2).alias("lang"), F.expr(
        "array_join(concat(array_repeat('both', 30), array_repeat(concat('w', id % 2), cast(2 + id % 3 as int))), ' ')").alias("text"))
    mixer = mixing.solve(docs, docs.select("doc_id"), "lang", weights={"a0": 0.55, "a1": 0.45}, budget=6000.0)
    t, p = mixer.memberships([r["text"].encode() for r in docs.select("text").collect()])
    assert mixer.ended == "met" and np.allclose((mixer.rates(p) * t) @ p, [3300, 2700], rtol=mixing.TOLERANCE)


def test_classifier_on_the_language(tables):
    docs, known = tables
    got = mixing.plan(docs, known).join(docs.select("doc_id", "lang"), "doc_id").where("n_tokens > 20").collect()
    assert np.mean([r["domain"] == r["lang"] for r in got]) > 0.97


def test_copies(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "cast(id % 4 as double) * 0.75 as rate")
    got = rows.select("rate", mixing.copies_of("rate").alias("n")).groupBy("rate").avg("n").collect()
    assert all(abs(r["avg(n)"] - r["rate"]) < 0.06 for r in got)


def test_awkward_rows(spark):
    docs = documents(spark)
    got = mixing.plan(docs, labels(spark)).collect()
    assert len(got) == docs.count() and all(0 <= r["rate"] <= 1 for r in got)
    out = mixing.mix(docs, labels(spark))
    rows = {repr(r) for r in docs.collect()}
    assert out.columns == docs.columns and all(repr(r) in rows for r in out.collect())
    no_labels = spark.createDataFrame([], LABEL_SCHEMA)
    assert sorted(map(repr, mixing.mix(docs, no_labels).collect())) == sorted(map(repr, docs.collect()))
    twice = mixing.mix(docs, labels(spark), weights={"en": 1.0}, budget=1e9, max_rate=2.0)
    assert twice.columns == docs.columns and twice.count() > 0
    none = spark.createDataFrame([], DOC_SCHEMA)
    assert mixing.plan(none, labels(spark)).count() == 0 and mixing.mix(none, labels(spark)).count() == 0


def test_weights_without_a_positive_one(tables):
    with pytest.raises(ValueError):
        mixing.solve(*tables, "lang", weights={"en": 0.0})
