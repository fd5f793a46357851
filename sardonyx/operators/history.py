"""Per-epoch history: the logged record, best-epoch rules and long-form training curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY_METRICS = ["train_loss", "train_sarc_loss", "train_acc", "train_f1",
                   "val_loss", "val_sarc_loss", "val_acc", "val_f1"]
HISTORY_COLUMNS = ["epoch", *HISTORY_METRICS, "epoch_time_sec"]
HISTORY_SCHEMA = ("epoch int, train_loss double, train_sarc_loss double, train_acc double, "
                  "train_f1 double, val_loss double, val_sarc_loss double, val_acc double, "
                  "val_f1 double, epoch_time_sec double")


def epoch_log(df: DataFrame) -> DataFrame:
    """The logged record; metrics rounded to 4 decimals, seconds to 1."""
    return df.select(F.col("epoch").cast("int").alias("epoch"),
                     *[F.round(F.col(c).cast("double"), 4).alias(c) for c in HISTORY_METRICS],
                     F.round(F.col("epoch_time_sec").cast("double"), 1).alias("epoch_time_sec"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch that was saved last = earliest maximum of val F1 above 0 (none if all 0)."""
    return (history.filter(F.col("val_f1") > 0).orderBy(F.desc("val_f1"), F.asc("epoch")).limit(1)
            .select(F.col("epoch").cast("int").alias("best_epoch"), F.col("val_f1").alias("best_val_f1")))


def best_epoch_rounded(history: DataFrame) -> DataFrame:
    """First epoch holding the maximum of the rounded val F1 (no floor at 0)."""
    r = F.round("val_f1", 4)
    return (history.select("epoch", r.alias("val_f1_rounded")).orderBy(F.desc("val_f1_rounded"),
                                                                       F.asc("epoch")).limit(1)
            .select(F.col("epoch").cast("int").alias("best_epoch"), "val_f1_rounded"))


def training_curves(history: DataFrame) -> DataFrame:
    """Long form ``epoch, metric, split, value`` for loss, F1 and accuracy curves."""
    cols = ["train_loss", "val_loss", "train_f1", "val_f1", "train_acc", "val_acc"]
    long = history.unpivot("epoch", cols, "column", "value")
    return long.select(
        F.col("epoch").cast("int").alias("epoch"),
        F.regexp_extract("column", r"^[a-z]+_(.*)$", 1).alias("metric"),
        F.regexp_extract("column", r"^([a-z]+)_", 1).alias("split"),
        F.col("value").cast("double").alias("value"))
