"""Evaluation tables: confusion, accuracy/F1, report, ROC/AUC, per-domain accuracy, histogram.

All of them start from one scored table (``label``, ``pred``, ``score``,
``domain_idx`` in the same row; nothing is zipped by position).  Class
metrics come from one 2x2 aggregate; ROC running sums are computed in two
levels (score bucket, then within bucket) so no window holds every distinct
score in one task.

One rule for odd rows: rows with a NULL label or prediction are not counted.
A label outside {0, 1} is a class of its own that is never predicted: such
rows count in ``n`` and against the predicted class's precision and are
always errors, but have no row in the report, the matrix or the histogram;
for the ROC they are not positive.  Rows with a NULL or NaN score are left
out of ROC, AUC and histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.operators.domains import domain_dimension


def _div(a: Column, b: Column) -> Column:
    """a / b as double, 0.0 when b is 0 (the zero-division rule of the reports)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


COUNTS = ("tn", "fp", "fn", "tp", "o0", "o1")


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row ``tn, fp, fn, tp`` (class 1 is positive) and ``o0, o1``: other labels, by prediction."""
    return df.agg(*confusion_aggregates(label, pred))


def confusion_aggregates(label: str = "label", pred: str = "pred") -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [
        F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
        F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
        F.count(F.when(~y.isin(0, 1) & (p == 0), 1)).alias("o0"),
        F.count(F.when(~y.isin(0, 1) & (p == 1), 1)).alias("o1"),
    ]


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Dense 2x2 counts, rows = true label: ``label, pred, n``."""
    return confusion_of(confusion_counts(df, label, pred))


def confusion_of(counts: DataFrame) -> DataFrame:
    """The matrix of a one-row table of ``confusion_counts``."""
    def cell(y: int, p: int, c: str) -> Column:
        return F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(c).alias("n"))

    return counts.select(F.inline(F.array(
        cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))))


def confusion_pct(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Row-normalised percent; NULL for a true class with no rows."""
    return pct_of(confusion(df, label, pred))


def pct_of(c: DataFrame) -> DataFrame:
    row_total = F.sum("n").over(Window.partitionBy("label"))
    pct = F.when(row_total == 0, F.lit(None).cast("double")).otherwise(
        F.col("n").cast("double") / row_total.cast("double") * F.lit(100.0))
    return c.withColumn("pct", F.round(pct, 6))


def class_stats(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of both classes, ``acc``, ``wf1`` (support-weighted) and ``total``."""
    tn, fp, fn, tp, o0, o1 = (F.col(c) for c in COUNTS)
    total = tn + fp + fn + tp + o0 + o1
    stats = counts.select(
        *keep, "tn", "fp", "fn", "tp",
        _div(tn, tn + fn + o0).alias("p0"), _div(tn, tn + fp).alias("r0"),
        _div(2 * tn, 2 * tn + fp + fn + o0).alias("f0"), (tn + fp).alias("s0"),
        _div(tp, tp + fp + o1).alias("p1"), _div(tp, tp + fn).alias("r1"),
        _div(2 * tp, 2 * tp + fp + fn + o1).alias("f1"), (tp + fn).alias("s1"),
        _div(tn + tp, total).alias("acc"), total.alias("total"))
    return stats.withColumn("wf1", _div(F.col("f0") * F.col("s0") + F.col("f1") * F.col("s1"), F.col("total")))


def accuracy_f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A5 + A6: ``accuracy``, support-weighted ``f1_weighted``, ``n``."""
    return accuracy_of(confusion_counts(df, label, pred))


def accuracy_of(counts: DataFrame) -> DataFrame:
    s = class_stats(counts)
    return s.select(F.round("acc", 6).alias("accuracy"), F.round("wf1", 6).alias("f1_weighted"),
                    F.col("total").alias("n"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred",
                          names: Sequence[str] = C.CLASS_NAMES) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    return report_of(confusion_counts(df, label, pred), names)


def report_of(counts: DataFrame, names: Sequence[str] = C.CLASS_NAMES) -> DataFrame:
    s = class_stats(counts)
    tot = F.col("total")

    def wavg(a, b):
        return _div(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), tot)

    def row(name, p, r, f, sup):
        return F.struct(F.lit(name).alias("row_name"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        sup.cast("bigint").alias("support"))

    none = F.lit(None).cast("double")
    rows = F.array(
        row(names[0], F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row(names[1], F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", none, none, F.col("acc"), tot),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
            (F.col("f0") + F.col("f1")) / 2, tot),
        row("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), tot),
    )
    out = s.select(F.inline(rows))
    return out.select("row_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")],
                      "support")


# ---------------------------------------------------------------------------
# ROC / AUC
# ---------------------------------------------------------------------------

LOGIT_SPAN = 40   # |logit| of any double probability strictly inside (0, 1) is below 40


def score_bucket(s: Column, per_unit: int) -> Column:
    """A bucket id that never decreases as the score grows, spread on the logit scale.

    Probabilities crowd near 0 and 1 (a saturated model puts a large share of
    all rows within 1e-6 of 1.0); on the logit scale those values are far
    apart, so no bucket collects them.  Scores outside (0, 1) get log-spaced
    buckets beyond both ends, keeping the order for any real score.
    """
    edge = LOGIT_SPAN * per_unit
    logit = F.log(s) - F.log(F.lit(1.0) - s)
    inner = F.least(F.greatest(F.floor(logit * per_unit), F.lit(1 - edge)), F.lit(edge - 1))
    return (F.when(s <= 0, F.lit(-edge) - F.ceil(F.log1p(-s) * per_unit))
            .when(s >= 1, F.lit(edge) + F.floor(F.log1p(s - 1) * per_unit))
            .otherwise(inner)).cast("bigint")


def _roc_groups(df: DataFrame, label: str, score: str, buckets: int) -> DataFrame:
    """Distinct scores with running positive/negative counts in descending score order.

    Level 1: per score bucket totals (``buckets`` per logit unit, about
    82 thousand for probabilities) and their prefix sums; level 2: running
    sums inside a bucket, joined on the bucket
    (the same key the window partitions by).  Also carries the counts of the
    next (lower) distinct score, needed for the collinear-point rule.
    """
    s = F.col(score).cast("double")
    g = df.filter(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).groupBy(s.alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) != 1, 1)).alias("neg"))
    g = g.withColumn("_b", score_bucket(F.col("score"), buckets))
    bt = g.groupBy("_b").agg(
        F.sum("pos").alias("_bpos"), F.sum("neg").alias("_bneg"),
        F.max_by(F.struct("pos", "neg"), "score").alias("_first"))
    down = Window.orderBy(F.desc("_b"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))   # over the bucket table only (bounded)
    bt = bt.select(
        "_b",
        F.coalesce(F.sum("_bpos").over(above), F.lit(0)).alias("_opos"),
        F.coalesce(F.sum("_bneg").over(above), F.lit(0)).alias("_oneg"),
        F.lead("_first").over(down).alias("_next_first"),
        F.sum("_bpos").over(everything).alias("n_pos"),
        F.sum("_bneg").over(everything).alias("n_neg"))
    j = g.join(bt, "_b", "left")
    w = Window.partitionBy("_b").orderBy(F.desc("score"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        "score", "pos", "neg", "n_pos", "n_neg",
        (F.col("_opos") + F.sum("pos").over(run)).alias("tps"),
        (F.col("_oneg") + F.sum("neg").over(run)).alias("fps"),
        F.coalesce(F.lead("pos").over(w), F.col("_next_first.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(w), F.col("_next_first.neg")).alias("next_neg"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score",
               buckets: int = C.ROC_BUCKETS) -> DataFrame:
    """A10 (+A20): ``threshold, fps, tps, fpr, tpr`` with collinear points dropped, origin first.

    A20's reference lines ride along: ``chance_tpr`` (the diagonal of a random
    classifier) and the 0.5 ``decision_threshold``.

    A point is kept when it is the first or last distinct score or when the
    counts added at the next score differ from its own (second difference of
    fps or tps non-zero).  The origin has threshold +inf.  Rates are NULL when
    a class is absent.
    """
    g = _roc_groups(df, label, score, buckets)
    first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
    last = F.col("next_pos").isNull()
    keep = first | last | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    pts = g.filter(keep).select(F.col("score").alias("threshold"), "fps", "tps", "n_pos", "n_neg")
    origin = g.filter(first).select(   # the highest score is one row: no second grouping
        F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("fps"),
        F.lit(0).cast("bigint").alias("tps"), "n_pos", "n_neg")
    allp = pts.unionByName(origin)

    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) == 0, F.lit(None).cast("double")).otherwise(
            F.col(a).cast("double") / F.col(b).cast("double"))

    fpr = F.round(rate("fps", "n_neg"), 6)
    return allp.select("threshold", "fps", "tps", fpr.alias("fpr"),
                       F.round(rate("tps", "n_pos"), 6).alias("tpr"),
                       fpr.alias("chance_tpr"),   # the random-classifier diagonal
                       F.lit(C.DECISION_THRESHOLD).alias("decision_threshold"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            buckets: int = C.ROC_BUCKETS) -> DataFrame:
    """Trapezoid area under the ROC curve (ties count one half) = rank-sum AUC."""
    g = _roc_groups(df, label, score, buckets)
    area = g.agg(F.sum(F.col("neg").cast("double") * (2 * F.col("tps") - F.col("pos")).cast("double"))
                 .alias("_a"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(None).cast("double")).otherwise(
        F.col("_a") / (F.lit(2.0) * F.col("n_pos") * F.col("n_neg")))
    return area.select(F.round(auc, 6).alias("auc"), F.col("n_pos").cast("bigint").alias("n_pos"),
                       F.col("n_neg").cast("bigint").alias("n_neg"))


# ---------------------------------------------------------------------------
# Per-domain accuracy, histogram
# ---------------------------------------------------------------------------

def tier(acc: Column) -> Column:
    """Good / fair / poor by accuracy."""
    return (F.when(acc >= F.lit(C.TIER_GOOD), F.lit("good"))
            .when(acc >= F.lit(C.TIER_FAIR), F.lit("fair")).otherwise(F.lit("poor")))


def domain_accuracy(df: DataFrame, domain_idx: str = "domain_idx", label: str = "label",
                    pred: str = "pred", labels: Sequence[str] = C.DOMAIN_LABELS,
                    rounded: bool = True) -> DataFrame:
    """A12 + A14: sarcasm accuracy per true domain; every domain listed (0.0 and n=0 when empty)."""
    per = df.groupBy(F.col(domain_idx).cast("int").alias("domain_idx")).agg(
        F.count(F.when(F.col(label) == F.col(pred), 1)).alias("_correct"),
        F.count(F.lit(1)).alias("_n"))
    dim = domain_dimension(df.sparkSession, labels)
    j = dim.join(per, "domain_idx", "left")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    acc = F.when(n > 0, F.col("_correct").cast("double") / n.cast("double")).otherwise(F.lit(0.0))
    return j.select("domain_idx", "domain", (F.round(acc, 6) if rounded else acc).alias("accuracy"), n.alias("n"),
                    tier(acc).alias("tier"))


def domain_accuracy_mean(per_domain: DataFrame) -> DataFrame:
    """Unweighted mean over all domains, empty ones counted as 0; give it unrounded accuracies."""
    return per_domain.agg(F.round(F.avg("accuracy"), 6).alias("mean_accuracy"),
                          F.count(F.lit(1)).alias("n_domains"))


def score_histogram(df: DataFrame, label: str = "label", score: str = "score",
                    bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width density histogram per true label over that label's own range.

    Edges ``lo + i*(hi-lo)/bins`` (``hi`` exact for the last); a value on an
    edge goes to the upper bin except the maximum, which closes the last bin;
    a single-valued range is widened by 0.5 on each side.  Density is
    ``n / width / total`` so the bars integrate to 1.
    """
    x = F.col(score).cast("double")
    # Only the two classes are drawn; this also bounds the broadcast stats table to 2 rows.
    df = df.filter(F.col(label).isin(0, 1) & x.isNotNull() & ~F.isnan(x))
    stats = df.groupBy(F.col(label).alias("label")).agg(
        F.min(x).alias("_lo0"), F.max(x).alias("_hi0"), F.count(x).alias("_total"))
    same = F.col("_lo0") == F.col("_hi0")
    stats = stats.select(
        "label", "_total",
        F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
        F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.col("_hi")).otherwise(i.cast("double") * step + F.col("_lo"))

    rows = df.select(F.col(label).alias("label"), x.alias("_x"))
    j = rows.join(F.broadcast(stats), "label")   # at most 2 rows
    raw = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins)))
    i0 = F.when(raw >= bins, F.lit(bins - 1)).otherwise(raw).cast("int")
    i1 = F.when(F.col("_x") < edge(F.col("_i0")), F.col("_i0") - 1).otherwise(F.col("_i0"))
    i2 = F.when((F.col("_x") >= edge(F.col("_i1") + 1)) & (F.col("_i1") != bins - 1),
                F.col("_i1") + 1).otherwise(F.col("_i1"))
    counted = (j.withColumn("_i0", i0).withColumn("_i1", i1).withColumn("bin", i2)
               .groupBy("label", "bin").agg(F.count(F.lit(1)).alias("_n")))
    grid = stats.select("label", "_lo", "_hi", "_total",
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    h = grid.join(counted, ["label", "bin"], "left")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    lo_e, hi_e = edge(F.col("bin")), edge(F.col("bin") + 1)
    dens = n.cast("double") / (hi_e - lo_e) / F.col("_total").cast("double")
    return h.select("label", "bin", F.round(lo_e, 6).alias("bin_lo"), F.round(hi_e, 6).alias("bin_hi"),
                    n.alias("n"), F.round(dens, 6).alias("density"),
                    F.lit(C.DECISION_THRESHOLD).alias("decision_threshold"))
