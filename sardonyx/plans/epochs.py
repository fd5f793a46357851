"""Per-epoch history tables from scored mini-batches.

``epoch_table`` turns rows ``(epoch, split, batch_id, label, pred,
sarcasm_loss, total_loss)`` into the 10-column history: loss = mean of batch
means, accuracy and support-weighted F1 from one 2x2 count per epoch and
split.  ``logit_path_history`` builds such rows from the fixed logits of the
embeddings table along a deterministic path (logits scaled by ``epoch/E``,
a shrinking bias on the positive class), so the history operators have a
data-derived input that SQL can restate.  The training loop feeds the same
function with the rows it scores after every pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.functions.numeric import argmax
from sardonyx.operators.losses import head_losses
from sardonyx.operators.metrics import COUNTS, class_stats, confusion_aggregates
from sardonyx.operators.ranking import batch_size_for, dense_ids, minibatches, stratified_split


def epoch_table(rows: DataFrame, label: str = "sarc_label") -> DataFrame:
    """History columns per epoch (unrounded; ``epoch_time_sec`` NULL unless joined in later)."""
    per_batch = rows.groupBy("epoch", "split", "batch_id").agg(
        F.avg("total_loss").alias("_t"), F.avg("sarcasm_loss").alias("_s"),
        *confusion_aggregates(label, "pred"))
    per = per_batch.groupBy("epoch", "split").agg(
        F.avg("_t").alias("loss"), F.avg("_s").alias("sarc_loss"),
        *[F.sum(c).alias(c) for c in COUNTS])
    per = class_stats(per, ["epoch", "split", "loss", "sarc_loss"]).withColumn("f1", F.col("wf1"))
    wide = per.groupBy("epoch").pivot("split", ["train", "val"]).agg(
        F.first("loss").alias("loss"), F.first("sarc_loss").alias("sarc_loss"),
        F.first("acc").alias("acc"), F.first("f1").alias("f1"))
    return wide.select(F.col("epoch").cast("int").alias("epoch"),
                       "train_loss", "train_sarc_loss", "train_acc", "train_f1",
                       "val_loss", "val_sarc_loss", "val_acc", "val_f1",
                       F.lit(None).cast("double").alias("epoch_time_sec"))


def path_logits(d: DataFrame, epochs: int = C.NUM_EPOCHS) -> DataFrame:
    """Logits of epoch ``e``: ``z * e/E``, plus ``(2 - e) / 4`` on the positive sarcasm class."""
    scale = F.col("epoch").cast("double") / F.lit(float(epochs))
    bias = (F.lit(2) - F.col("epoch")).cast("double") * F.lit(0.25)
    s, dl = F.col("sarcasm_logits"), F.col("domain_logits")
    return d.withColumns({
        "sarcasm_logits": F.array(s.getItem(0) * scale + F.lit(0.0), s.getItem(1) * scale + bias),
        "domain_logits": F.array(*[dl.getItem(i) * scale for i in range(len(C.DOMAIN_LABELS))])})


def logit_path_history(logits: DataFrame, epochs: int = C.NUM_EPOCHS) -> DataFrame:
    """History of the fixed-logit path over the train and val splits of ``logits``."""
    d = stratified_split(logits, "sarc_label", "row_key", materialize_input=False)   # plain scan
    d = dense_ids(d, ["split"])
    d = minibatches(d, "row_no", batch_size_for("split"))
    d = d.filter(F.col("split").isin("train", "val"))
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    d = head_losses(path_logits(d, epochs))
    d = d.withColumn("pred", argmax("sarcasm_logits"))
    return epoch_table(d)
