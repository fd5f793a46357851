"""File sources and sinks: headline JSON lines, forum CSV, epoch-history JSON array.

JSON schemas are explicit (never inferred) so batch and streaming reads agree
and a missing optional field simply reads as NULL.  CSV columns are text, named
by the header, which all files of a read must share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.operators.history import HISTORY_SCHEMA

# The label is read as text and cast by the cleaning step (junk -> dropped).
HEADLINE_SCHEMA = "row_id bigint, is_sarcastic string, headline string, article_link string"
FORUM_COLUMNS = ["label", "comment", "subreddit"]


def read_headlines(spark: SparkSession, path: str, schema: str = HEADLINE_SCHEMA) -> DataFrame:
    """S1 + S3: UTF-8 JSON lines; blank lines are skipped, a malformed line fails the read.

    ``row_id`` is optional (NULL when absent); so is ``article_link``.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)


def read_forum_csv(spark: SparkSession, path: str, columns=FORUM_COLUMNS,
                   null_words=C.CSV_NULL_WORDS, partitions: int | None = None) -> DataFrame:
    """CSV with a header; only ``columns`` (+ ``row_id`` if present) are kept.

    Fields are read as text; quoted fields may hold doubled quotes and line
    breaks; short lines are padded with NULL and extra fields ignored
    (PERMISSIVE); the usual CSV null words become NULL.  Every file's header is
    checked against the first one read: files whose columns differ in name or
    order end the read with an error (``enforceSchema`` off) instead of mixing
    columns.  Multi-line parsing makes one file one task; ``partitions`` spreads
    the rows again after the scan.
    """
    reader = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
              .option("mode", "PERMISSIVE").option("encoding", "UTF-8"))
    first = reader.csv(path).schema
    raw = reader.schema(first).option("enforceSchema", False).csv(path)
    keep = (["row_id"] if "row_id" in raw.columns else []) + list(columns)
    out = raw.select(*[F.when(F.col(c).isin(list(null_words)), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c != "row_id" else F.col(c).cast("bigint").alias(c) for c in keep])
    return out.repartition(partitions) if partitions else out


def write_headlines(df: DataFrame, path: str) -> None:
    """JSON lines (NULL fields are omitted, as in files where the link is missing)."""
    df.write.mode("overwrite").json(path)


def write_forum_csv(df: DataFrame, path: str) -> None:
    """CSV with header, RFC-4180 quoting (doubled quotes), values written unchanged."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_history(history: DataFrame, path: str) -> None:
    """The history as one JSON array (epochs in order) in a single text file.

    The epoch table has one row per epoch, so gathering it into one value is bounded.
    """
    arr = history.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*history.columns)))).alias("value"))
    arr.coalesce(1).write.mode("overwrite").text(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A whole-file JSON array of epoch records."""
    return spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).json(path)
