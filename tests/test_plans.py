"""Plan properties that must hold for every registered query (checked on the smallest scale)."""

import re

import pytest

from sardonyx.plans.catalog import QUERIES
from tests.conftest import SF_SMALL

FORBIDDEN = r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas"
SKIP = {"train_two_heads", "evaluate_best", "full_evaluation", "score_stream",
        "evaluation_supports", "score_batch_checks", "score_stream_checks"}   # Spark ML loops / streams


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in SKIP])
def test_no_cross_joins_or_python(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(FORBIDDEN, plan), name


def _keyed(spark):
    from pyspark.sql import functions as F
    from sardonyx.functions.text import row_key
    return spark.range(1000).withColumn("label", (F.col("id") % 2).cast("int")) \
        .withColumn("text", F.repeat(F.lit("long text "), 50)).withColumn("row_key", row_key(F.lit("t"), F.col("id")))


def test_copies_rank_window_is_bucketed(spark):
    from sardonyx.operators.ranking import two_level_rank
    plan = two_level_rank(_keyed(spark), ["label"], materialize_input=False)._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*", plan)
    # the row-level rank window is partitioned by (eligible, label, bucket), never by label alone
    assert any("_bucket" in w and "row_number" in w for w in windows)


@pytest.mark.parametrize("job", ["split", "cap"])
def test_no_exchange_carries_text(spark, job):
    """Split and cap compare rows with cut-off keys: what is shuffled are keys and counts."""
    from sardonyx.operators.ranking import class_cap, stratified_split
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = (stratified_split(_keyed(spark), materialize_input=False) if job == "split"
             else class_cap(_keyed(spark), "label", 100, materialize_input=False))
        plan = d._jdf.queryExecution().executedPlan()
        nodes, text = [plan], []
        while nodes:
            n = nodes.pop()
            if n.nodeName().startswith("Exchange") and "text" in n.output().toString():
                text.append(n.nodeName())
            nodes += [n.children().apply(i) for i in range(n.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert not text
    assert d.count() == 1000


def test_frames_that_are_written(spark, monkeypatch):
    """The plans behind the written tables: corpus, encoding, history, features, scores."""
    from pyspark.sql.readwriter import DataFrameWriter

    from sardonyx.plans import catalog
    plans, real = [], DataFrameWriter.parquet

    def spy(self, path, *args, **kwargs):
        plans.append((path, self._df._jdf.queryExecution().executedPlan().toString()))
        return real(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    catalog.forget_prepared()
    for name in ("clean_corpus", "encoded_sequences", "epoch_history", "train_two_heads", "full_evaluation"):
        QUERIES[name](spark, SF_SMALL).collect()
    kinds = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p, _ in plans}
    assert {"flagged-corpus", "encoded", "path-history", "features", "scored-test"} <= kinds
    for path, plan in plans:
        assert not re.search(FORBIDDEN, plan), path


def test_scopes_hand_kept_tables_outwards(spark):
    from sardonyx.session import path_exists, scratch_dir, scratch_scope, write_table
    with scratch_scope(spark) as outer:
        with scratch_scope(spark) as inner:
            gone, kept = (write_table(spark.range(3), "t") for _ in range(2))
            inner.keep(kept)
        assert not path_exists(spark, gone) and path_exists(spark, kept)
        last = outer.keep(write_table(spark.range(3), "t"))
    assert not path_exists(spark, kept) and path_exists(spark, last)
    assert scratch_dir(spark, "t") != last
