"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two partially aggregated minima and two joins on node ids, and
writes its (never growing) edge table to the checkpoint folder, so lineage
stays short and a lost executor costs a re-read.  Nothing is collected but a
count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sardonyx.llm.common import stored
from sardonyx.session import delete_path, ensure_checkpoint_dir, scratch_scope, write_table


def _mark(edges: DataFrame) -> tuple:
    # a sum that can't overflow: checksums are cut to 32 bits
    r = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 32)))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``: the smallest node that it reaches."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    path = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .distinct(), "edges")
    e = spark.read.parquet(path)
    mark = _mark(e)
    while mark[0]:
        with scratch_scope(spark) as scope:  # a round's tables go when the next edge table is written
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = stored(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                           .where("a <> b").distinct(), "large-star")
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            done, path = path, scope.keep(write_table(
                small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star"))
        delete_path(spark, done)
        e = spark.read.parquet(path)
        if (now := _mark(e)) == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
