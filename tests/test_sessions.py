"""Stop words end sessions: within a batch, over micro-batches, after a restart, and in every column type."""

import datetime as dt

from pyspark.sql import functions as F

from sardonyx.streaming import sessions as SS

SCHEMA = "conv_id bigint, turn bigint, text string, score double, at timestamp, flag boolean"
NOW = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)


def row(conv, turn, text):
    return (conv, turn, text, None if turn is None else 0.1 * turn, NOW, None if turn == 1 else True)


FIRST = [row(1, 0, "hello there"), row(1, 1, "  QUIT "), row(1, 2, "late"), row(2, 0, "quitting time"), row(2, 1, None),
         row(None, 0, "no id"), row(None, 2, "quit"), row(3, 5, "five"), row(4, None, "quit"), row(4, 3, "after null"),
         row(2 ** 60 + 1, 0, "large id")]
SECOND = [row(1, 3, "later still"), row(1, 0, "early turn that comes late"), row(2, 2, "goes on"), row(None, 3, "gone"),
          row(None, 1, "before the stop"), row(3, 4, "quit"), row(3, 6, "gone"), row(3, 3, "open")]
THIRD = [row(2, 3, "quit"), row(2, 2, "second two"), row(3, 9, "gone"), row(5, 0, "new")]


def wanted(batches):
    ended, out = {}, []
    for rows in batches:
        for c, t, x, *_ in rows:
            if x is not None and x.strip().lower() == "quit":
                ended[c] = min(ended.get(c, 1 << 62), SS.FIRST if t is None else t)
        out += [r for r in rows if (SS.FIRST if r[1] is None else r[1]) < ended.get(r[0], 1 << 62)]
    return sorted(out, key=repr)


def run(spark, source, out, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = (SS.open_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return sorted((tuple(r) for r in spark.read.schema(SCHEMA).parquet(out).collect()), key=repr)


def test_batch_table(spark):
    df = spark.createDataFrame(FIRST + SECOND + THIRD, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in SS.open_rows(df).collect()), key=repr)
    assert got == wanted([FIRST + SECOND + THIRD]) and SS.open_rows(df).columns == df.columns
    assert SS.open_rows(df.limit(0)).collect() == []


def test_stream_over_batches_and_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    spark.createDataFrame(FIRST, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run(spark, source, out, checkpoint) == wanted([FIRST])
    # a new query on the same checkpoint: the ended sessions are still ended
    spark.createDataFrame(SECOND, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run(spark, source, out, checkpoint) == wanted([FIRST, SECOND])
    spark.createDataFrame(THIRD, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run(spark, source, out, checkpoint) == wanted([FIRST, SECOND, THIRD])
    assert run(spark, source, out, checkpoint) == wanted([FIRST, SECOND, THIRD])


def test_one_batch_equals_the_table(spark, tmp_path):
    rows = FIRST + SECOND + THIRD
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    table = SS.open_rows(spark.createDataFrame(rows, SCHEMA))
    assert got == sorted((tuple(r) for r in table.collect()), key=repr) and len(got) > 5


def test_a_hot_session(spark):
    df = spark.range(50_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 30_000, "quit").otherwise("x").alias("text"))
    assert SS.open_rows(df).count() == 30_000
