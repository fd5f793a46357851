import zlib

import numpy as np
import pytest

from sardonyx.llm import quality
from tests.conftest import SF_CHECK
from tests.llm.frames import DOC_SCHEMA, LABEL_SCHEMA, documents, labels


def plain_score(model, row):
    """One row through the trees, one node at a time."""
    total = model.base
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    known = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    got = quality.predictions(docs, known)
    rows = got.join(known, "doc_id").where("held_out").collect()
    assert got.count() == docs.count() and len(rows) > 100
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.collect())


def test_traversal_and_fit():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.3) & (x[:, 5] < 1)).astype(float)
    model = quality.fit_trees(x, y, trees=20)
    got = model.scores(x, rows=64)
    assert np.allclose(got[:50], [plain_score(model, r) for r in x[:50]])
    assert ((got >= 0.5) == y).mean() > 0.98


@pytest.mark.parametrize("y", [np.zeros(0), np.ones(4), np.zeros(4)])
def test_one_kind_of_label_gives_its_share(y):
    model = quality.fit_trees(np.zeros((len(y), len(quality.FEATURES))), y)
    assert np.allclose(model.scores(np.zeros((3, len(quality.FEATURES)))), (y.sum() + 1) / (len(y) + 2))
    assert len(model.scores(np.zeros((0, len(quality.FEATURES))))) == 0


def test_awkward_rows(spark):
    docs = documents(spark)
    got = quality.predictions(docs, labels(spark)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.accept(docs, labels(spark), threshold=0.0)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
    none = spark.createDataFrame([], LABEL_SCHEMA)
    assert {r["score"] for r in quality.predictions(docs, none).collect()} == {0.5}
    assert quality.predictions(spark.createDataFrame([], DOC_SCHEMA), labels(spark)).count() == 0


def test_bounded_fit(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('text ', id) as text")
    known = spark.range(500).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    assert isinstance(quality.fit(docs, known, most=50), quality.Trees)
