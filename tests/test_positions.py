"""Positions of rows in their input, over many files and splits."""

import pytest

from sardonyx.sources.positions import read_in_order


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_a_file_in_many_splits(spark, tmp_path, small_splits):
    lines = [f"line {i} " + "x" * (i * 37 % 90) for i in range(2000)]
    for k, name in enumerate(("a.txt", "b.txt", "c.txt")):
        (tmp_path / name).write_text("\n".join(lines[700 * k:700 * k + 700]) + "\n", encoding="utf-8")
    df = read_in_order(spark, str(tmp_path), "text")
    assert df.select("value").rdd.getNumPartitions() > 4
    got = {r["position"]: r["value"] for r in df.collect()}
    assert got == dict(enumerate(lines)) and df.columns == ["value", "position"]


def test_json_lines(spark, tmp_path, small_splits):
    (tmp_path / "h.json").write_text("".join(f'{{"n": {i}, "t": "row {i}"}}\n' for i in range(900)), encoding="utf-8")
    got = read_in_order(spark, str(tmp_path / "h.json"), "json", "n bigint, t string").collect()
    assert len(got) == 900 and all(r["position"] == r["n"] for r in got)


def test_parquet_files(spark, tmp_path, small_splits):
    spark.range(0, 5000, 1, 7).selectExpr("id", "concat('t', id) as text").write.parquet(str(tmp_path / "t"))
    got = read_in_order(spark, str(tmp_path / "t")).collect()
    assert sorted(r["position"] for r in got) == list(range(5000)) and all(r["position"] == r["id"] for r in got)


def test_empty_and_multiline(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "t"))
    assert read_in_order(spark, str(tmp_path / "t")).collect() == []
    with pytest.raises(ValueError, match="several lines"):
        read_in_order(spark, str(tmp_path / "t"), "csv", "a string", multiLine=True)
