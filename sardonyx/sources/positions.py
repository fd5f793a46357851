"""I8: the place of every row in its input, without sorting rows.

Rows are read by many tasks, so a result table has no order of its own.  With
``position`` a reader can put results back into input order, or fetch the
records of some lines: it is the 0-based place of a row in the files taken in
path order.  Only counts move: how many rows each file (or each split of a
file) holds, and a prefix sum over that small table.

* Parquet knows a row's index in its file, so a file's offset is added to it.
* Line formats are read in splits (byte ranges of a file).  A split is read by
  one task from start to end, so a row's place in it is its task-local number
  less the split's first one; the offset is that of all splits before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PART = ["_file", "_block"]


def _with_offsets(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with ``position`` from ``_place`` (place in the part) and the parts' sizes."""
    order = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)   # one row per split
    offsets = parts.select("_file", "_block", F.col("_first"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_place") - F.col("_first")
    return rows.join(offsets, _PART).withColumn("position", place.cast("bigint")).drop(*_PART, "_place", "_first", "_before")


def read_in_order(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """The files below ``path`` with ``position``, each row's place in them.

    Both passes (sizes, rows) read the same files with the same splits, so the
    session's split settings must not change between building and running it.
    """
    reader = spark.read.format(fmt).options(**options)
    source = (reader.schema(schema) if schema else reader).load(path)
    if fmt == "parquet":
        rows = source.select("*", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("bigint").alias("_block"),
                             F.col("_metadata.row_index").alias("_place"))
        sizes = rows.groupBy(*_PART).agg(F.count(F.lit(1)).alias("_n"), F.lit(0).cast("bigint").alias("_first"))
    else:
        if options.get("multiLine") or options.get("multiline"):
            raise ValueError("records over several lines are read by one task per file: use their row numbers")
        rows = source.select("*", F.col("_metadata.file_path").alias("_file"),
                             F.col("_metadata.file_block_start").alias("_block"),
                             F.monotonically_increasing_id().alias("_place"))
        sizes = rows.groupBy(*_PART).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    return _with_offsets(rows, sizes)
