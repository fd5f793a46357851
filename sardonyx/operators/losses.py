"""Cross-entropy of the two heads, the weighted total, and the mean of batch means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.functions.numeric import cross_entropy


def head_losses(df: DataFrame, sarcasm_logits: str = "sarcasm_logits",
                domain_logits: str = "domain_logits", sarc_label: str = "sarc_label",
                domain_label: str = "domain_label") -> DataFrame:
    """G2 + G3: per-row ``sarcasm_loss``, ``domain_loss`` and ``total_loss = 0.7 s + 0.3 d``."""
    s = cross_entropy(sarcasm_logits, sarc_label, 2)
    d = cross_entropy(domain_logits, domain_label, len(C.DOMAIN_LABELS))
    return df.withColumns({"sarcasm_loss": s, "domain_loss": d}).withColumn(
        "total_loss", F.lit(C.SARCASM_LOSS_WEIGHT) * F.col("sarcasm_loss")
        + F.lit(C.DOMAIN_LOSS_WEIGHT) * F.col("domain_loss"))


def batch_mean_loss(df: DataFrame, batch: str = "batch_id",
                    cols: Sequence[str] = ("total_loss", "sarcasm_loss", "domain_loss")) -> DataFrame:
    """A4: the mean over batches of each batch's mean (not the row mean when the last batch is short).

    Two aggregates: per batch (one shuffle on the batch id, partial
    aggregation first), then over the batch table.
    """
    per = df.groupBy(batch).agg(*[F.avg(c).alias(c) for c in cols],
                                F.count(F.lit(1)).alias("_rows"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"),
                   *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in cols])
