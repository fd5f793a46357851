"""The final evaluation of a scored table, as long-form rows.

Every table is ``section, name, metric, value, note``: the classification
report, the confusion matrix (counts and percent), ROC points and AUC,
accuracy per domain with its tier and their mean, the score histogram and, if
a training history is given, its curves.  Report, matrix, accuracy and F1
come from one written 2x2 aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.operators import history as H
from sardonyx.operators import losses as L
from sardonyx.operators import metrics as MX
from sardonyx.operators.ranking import dense_ids, minibatches
from sardonyx.session import materialize


def long_rows(df: DataFrame, section: str, name: Column, metrics: Sequence[str], note: Column | None = None) -> DataFrame:
    """One row per metric of each row of a metrics table."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"),
                     (F.lit(None) if note is None else note).cast("string").alias("note"),
                     F.explode(cells).alias("_c")).select("section", "name", "_c.metric", "_c.value", "note")


def _class_tables(counts: DataFrame) -> list[DataFrame]:
    return [long_rows(MX.accuracy_of(counts), "overall", F.lit("all"), ["accuracy", "f1_weighted", "n"]),
            long_rows(MX.report_of(counts), "report", F.col("row_name"), ["precision", "recall", "f1_score", "support"])]


def final_test(scored: DataFrame) -> DataFrame:
    """Accuracy, weighted F1, report, and means of batch losses in the split's order (``row_key``)."""
    counts = materialize(MX.confusion_counts(scored), "confusion-counts")
    d = minibatches(dense_ids(scored, [], "row_key", "row_no", materialize_input=False), "row_no", 2 * C.BATCH_SIZE)
    d = d.withColumn("total_loss", F.lit(C.SARCASM_LOSS_WEIGHT) * F.col("sarcasm_loss")
                     + F.lit(C.DOMAIN_LOSS_WEIGHT) * F.col("domain_loss"))
    losses = long_rows(L.batch_mean_loss(d), "losses", F.lit("all"),
                       ["mean_total_loss", "mean_sarcasm_loss", "mean_domain_loss"])
    return reduce(DataFrame.unionByName, [*_class_tables(counts), losses])


def full_evaluation(scored: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Every evaluation table of one scored table; curves only where there is a history."""
    counts = materialize(MX.confusion_counts(scored), "confusion-counts")
    domains = MX.domain_accuracy(scored)
    parts = [
        *_class_tables(counts),
        long_rows(MX.pct_of(MX.confusion_of(counts)), "confusion", F.concat_ws(",", "label", "pred"), ["n", "pct"]),
        long_rows(MX.roc_points(scored), "roc", F.col("threshold"), ["fps", "tps", "fpr", "tpr"]),
        long_rows(MX.roc_auc(scored), "roc_auc", F.lit("all"), ["auc", "n_pos", "n_neg"]),
        long_rows(domains, "domain", F.col("domain"), ["accuracy", "n"], F.col("tier")),
        long_rows(MX.domain_accuracy_mean(MX.domain_accuracy(scored, rounded=False)), "domain_mean", F.lit("all"),
                  ["mean_accuracy", "n_domains"]),
        long_rows(MX.score_histogram(scored), "histogram", F.concat_ws(",", "label", "bin"),
                  ["bin_lo", "bin_hi", "n", "density"]),
    ]
    if history is not None:
        parts.append(long_rows(H.training_curves(history), "curves", F.concat_ws(",", "epoch", "split"), ["value"],
                               F.col("metric")))
    return reduce(DataFrame.unionByName, parts)
