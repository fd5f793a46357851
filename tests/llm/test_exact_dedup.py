from collections import defaultdict

from sardonyx.llm import exact_dedup
from tests.llm.frames import DOC_SCHEMA, documents


def _expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    return groups


def test_awkward_rows(spark):
    docs = documents(spark)
    groups = _expected(docs.collect())
    got = exact_dedup.decisions(docs).collect()
    assert len(got) == docs.count()
    assert sum(r["kept"] for r in got) == len(groups)  # exactly one row of each group
    sizes = sorted(len(v) for v in groups.values() for _ in v)
    assert sorted(r["group_size"] for r in got) == sizes
    by_text = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert {r["keep_id"] for r in got} == set(by_text.values())


def test_every_split_gives_the_same(spark):
    docs = documents(spark)
    base = sorted(exact_dedup.decisions(docs).collect(), key=repr)
    for support in (0.01, 0.1, 0.9):
        assert sorted(exact_dedup.decisions(docs, support).collect(), key=repr) == base


def test_hot_group_is_broadcast(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    got = exact_dedup.decisions(rows, 0.01)
    assert got.where("kept").count() == 2001
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000


def test_dedup_keeps_columns(spark):
    docs = documents(spark)
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len({r["text"] or "" for r in docs.collect()}) and all(r["_row"] == "r" for r in rows)


def test_empty(spark):
    assert exact_dedup.decisions(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.decisions(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
