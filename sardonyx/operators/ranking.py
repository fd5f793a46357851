"""Exact, repeatable ranks, class caps, stratified splits, dense ids and mini-batches.

A rank over a whole stratum (e.g. all rows of label 1) must not run as one
window task.  ``two_level_rank`` splits every stratum into ``16**k`` buckets
by the leading hex digits of the md5 row key: bucket sizes are counted
(partial aggregation, tiny result), turned into prefix offsets per stratum,
and joined back on ``(stratum, bucket)`` -- the same keys the row-level
window partitions by, so the rows are shuffled exactly once and each window
task holds about ``1/16**k`` of a stratum.  Ordering by ``(bucket, key)``
equals ordering by ``key`` because the bucket is a prefix of the key, so the
result is the plain ``row_number`` per stratum, for any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.session import materialize


def two_level_rank(df: DataFrame, by: Sequence[str], key: str = "row_key", out: str = "rank",
                   eligible: Column | None = None, hex_digits: int = C.RANK_BUCKET_HEX,
                   per_stratum: Callable[[DataFrame], DataFrame] | None = None,
                   materialize_input: bool = True, unique_keys: bool = True) -> DataFrame:
    """Add a 0-based rank of ``key`` within ``by`` (NULL for rows not ``eligible``).

    ``key`` must be a lower-case hex string (md5).  ``per_stratum`` may map the
    stratum sizes ``(by..., n)`` to extra per-stratum columns (quotas); they are
    attached through the same join as the offsets, so no extra row shuffle.
    The input is read twice (sizes, then ranks).  With ``materialize_input``
    it is written once to the checkpoint folder so expensive upstream work
    (joins, other ranks, text rules) is not repeated; callers whose input is
    a plain scan pass False, since the size pass then reads only key columns.

    ``unique_keys=False`` is for keys that may repeat (content keys of sources
    without ids, where a group of copies can be a large share of the rows):
    see :func:`_rank_with_copies`.
    """
    by = list(by)
    if not unique_keys:
        return _rank_with_copies(df, by, key, out, eligible, hex_digits, per_stratum)
    elig = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    d = df.withColumns({"_bucket": F.substring(F.col(key), 1, hex_digits), "_elig": elig})
    if materialize_input:
        d = materialize(d, "rank-input")
    counts = d.filter("_elig").groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _bucket_offsets(counts, by)
    if per_stratum is not None:
        sizes = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
        offsets = offsets.join(per_stratum(sizes), on=by, how="left")
    # Plain equality on (stratum, bucket): the join's hash partitioning on these
    # keys also satisfies the window below, so the rows move once.  Rows with a
    # NULL stratum find no offset and are not ranked.
    joined = d.join(offsets, on=[*by, "_bucket"], how="left")
    w = Window.partitionBy("_elig", *by, "_bucket").orderBy(key)
    rank = F.when(F.col("_elig"), F.col("_offset") + F.row_number().over(w) - 1)
    return joined.withColumn(out, rank.cast("bigint")).drop("_bucket", "_elig", "_offset")


def _bucket_offsets(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, _bucket, _n)`` -> ``(by, _bucket, _offset)``: rows in earlier buckets of the stratum.

    The window runs over the bucket table (at most ``16**k`` rows per stratum).
    """
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def _rank_with_copies(df: DataFrame, by: Sequence[str], key: str, out: str,
                      eligible: Column | None, hex_digits: int,
                      per_stratum: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Rank when many rows may share one key (copies).

    Rows with equal keys are interchangeable, so only how many of them fall
    in each rank range matters.  The input partition id is stored with each
    row (one write, so both passes see the same value); the counted unit is
    ``(stratum, key, partition)``, so a key with copies in every partition
    becomes at most one unit per partition instead of one huge group.  Units
    are ranked in ``(key, partition)`` order with the usual two levels
    (weighted by their sizes); each row then takes its unit's offset plus its
    position inside the unit, a window bounded by one input partition.
    """
    elig = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    d = materialize(df.withColumns({"_elig": elig, "_pid": F.spark_partition_id()}), "rank-input")
    units = (d.filter("_elig").groupBy(*by, key, "_pid").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_bucket", F.substring(F.col(key), 1, hex_digits)))
    counts = units.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_n"))
    offsets = _bucket_offsets(counts, by)
    inside = Window.partitionBy(*by, "_bucket").orderBy(key, "_pid").rowsBetween(Window.unboundedPreceding, -1)
    u = units.join(offsets, on=[*by, "_bucket"], how="left").select(
        *by, key, "_pid",
        (F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_uoffset"))
    if per_stratum is not None:
        sizes = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
        u = u.join(per_stratum(sizes), on=by, how="left")
    joined = d.join(u, on=[*by, key, "_pid"], how="left")
    w = Window.partitionBy("_elig", *by, key, "_pid").orderBy(key)
    rank = F.when(F.col("_elig"), F.col("_uoffset") + F.row_number().over(w) - 1)
    return joined.withColumn(out, rank.cast("bigint")).drop("_elig", "_pid", "_uoffset")


# ---------------------------------------------------------------------------
# M1: per-class exact cap
# ---------------------------------------------------------------------------

def cutoff_keys(df: DataFrame, by: str, thresholds: Callable[[DataFrame], DataFrame], names: Sequence[str],
                key: str = "row_key", eligible: Column | None = None,
                hex_digits: int = C.RANK_BUCKET_HEX) -> DataFrame:
    """One row per ``by``: for each rank threshold the key at that rank (``_cut_<name>``).

    ``thresholds`` maps the sizes ``(by, n)`` to columns ``names`` of ranks; a
    row is below a threshold exactly if its key is below the cut-off (``~``,
    above every hex key, where the threshold is the whole size).  Buckets
    wholly below or above a threshold need no rank: only the one boundary
    bucket per class and threshold is ranked, on its key columns.  Keys must
    be unique within a class.
    """
    elig = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    d = df.filter(elig & F.col(by).isNotNull()).select(by, F.col(key).alias("_key"),
                                                       F.substring(F.col(key), 1, hex_digits).alias("_bucket"))
    counts = d.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = thresholds(counts.groupBy(by).agg(F.sum("_n").alias("n")))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = sizes.select(by, F.explode(F.array(*[
        F.struct(F.lit(n).alias("_name"), F.col(n).cast("bigint").alias("_rank")) for n in names])).alias("_t")) \
        .select(by, "_t._name", "_t._rank")
    edge = offsets.join(wanted, by).filter((F.col("_rank") >= F.col("_offset"))
                                           & (F.col("_rank") < F.col("_offset") + F.col("_n")))
    w = Window.partitionBy(by, "_name", "_bucket").orderBy("_key")
    at = (d.join(edge.select(by, "_bucket", "_name", (F.col("_rank") - F.col("_offset")).alias("_need")),
                 [by, "_bucket"])
          .withColumn("_pos", F.row_number().over(w) - 1).filter("_pos = _need"))
    found = at.groupBy(by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_key"))).alias(f"_cut_{n}") for n in names])
    return sizes.select(by).join(found, by, "left").select(
        by, *[F.coalesce(f"_cut_{n}", F.lit("~")).alias(f"_cut_{n}") for n in names])


def class_cap(df: DataFrame, label: str, max_samples: int | None = None,
              classes: Sequence[int] = (1, 0), key: str = "row_key",
              out: str = "sampled", materialize_input: bool = True,
              unique_keys: bool = True) -> DataFrame:
    """Flag rows whose label is one of ``classes``; with ``max_samples`` only
    ``min(max_samples // 2, class size)`` of each class, lowest keys first.

    Without ``max_samples`` nothing is cut.  With it and unique keys, the rows
    are compared with one cut-off key per class (no row moves).
    """
    lab = F.col(label)
    elig = F.coalesce(lab.isNotNull() & lab.isin(list(classes)), F.lit(False))
    if max_samples is None:
        return df.withColumn(out, elig)
    per_class = max_samples // 2

    def quota(sizes: DataFrame) -> DataFrame:
        return sizes.select(label, F.least(F.col("n"), F.lit(per_class)).alias("_quota"))

    if unique_keys:
        # what feeds the rows (a join, text rules) runs once for the passes over the keys
        keys = df.filter(elig).select(label, key)
        cuts = cutoff_keys(materialize(keys, "cap-keys") if materialize_input else keys, label, quota, ["_quota"], key)
        flag = elig & F.coalesce(F.col(key) < F.col("_cut__quota"), F.lit(False))
        # one row per class; a shuffle by label would send all rows of a class to one task
        return df.join(F.broadcast(cuts), label, "left").withColumn(out, flag).select(*df.columns, out)
    ranked = two_level_rank(df, [label], key, "_cap_rank", elig, per_stratum=quota,
                            materialize_input=materialize_input, unique_keys=unique_keys)
    flag = F.coalesce(F.col("_cap_rank") < F.col("_quota"), F.lit(False))
    return ranked.withColumn(out, flag).drop("_cap_rank", "_quota")


# ---------------------------------------------------------------------------
# Stratified three-way split with exact sizes
# ---------------------------------------------------------------------------

def _largest_remainder(sizes: DataFrame, label: str, n_col: str, draws: Column,
                       total: Column, out: str) -> DataFrame:
    """Apportion ``draws`` over classes: floor of the share, +1 by largest remainder.

    Remainder ties go to the smaller label.  Runs on the per-class table only.
    """
    # the product of two counts does not fit a long beyond some 3e9 rows a class
    wide = F.col(n_col).cast("decimal(18,0)") * draws.cast("decimal(18,0)")
    share = wide.cast("double") / total.cast("double")
    d = sizes.withColumn("_share", F.when(total > 0, share).otherwise(F.lit(0.0)))
    d = d.withColumn("_floor", F.floor("_share").cast("bigint"))
    d = d.withColumn("_rem", F.col("_share") - F.col("_floor"))
    everything = Window.partitionBy(F.lit(0))
    need = draws - F.sum("_floor").over(everything)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rem"), F.asc(label)))
    d = d.withColumn(out, F.col("_floor") + F.when(order <= need, 1).otherwise(0))
    return d.drop("_share", "_floor", "_rem")


def split_quotas(sizes: DataFrame, label: str = "label", test: float = C.TEST_SPLIT,
                 val_of_rest: float = C.VAL_OF_REST) -> DataFrame:
    """Per-class ``n_test, n_val, n_train`` from class sizes ``(label, n)``.

    Same sizes as two successive stratified shuffle splits: ``ceil(test*N)``
    rows to test, then ``ceil(val_of_rest*R)`` of the rest ``R`` to validation,
    each apportioned over classes by largest remainder.
    """
    everything = Window.partitionBy(F.lit(0))
    n_all = F.sum("n").over(everything)
    d = sizes.withColumn("_N", n_all)
    d = d.withColumn("_R", F.col("_N") - F.ceil(F.lit(float(test)) * F.col("_N")).cast("bigint"))
    d = _largest_remainder(d, label, "n", F.col("_R"), F.col("_N"), "_rest")
    d = d.withColumn("n_test", F.col("n") - F.col("_rest"))
    d = d.withColumn("_R2", F.col("_R") - F.ceil(F.lit(float(val_of_rest)) * F.col("_R")).cast("bigint"))
    d = _largest_remainder(d, label, "_rest", F.col("_R2"), F.col("_R"), "n_train")
    d = d.withColumn("n_val", F.col("_rest") - F.col("n_train"))
    return d.select(label, "n", "n_test", "n_val", "n_train")


def stratified_split(df: DataFrame, label: str = "label", key: str = "row_key",
                     eligible: Column | None = None, out: str = "split",
                     materialize_input: bool = True, unique_keys: bool = True) -> DataFrame:
    """Add ``split`` in {'train','val','test'} (NULL for rows not eligible).

    Within each class the lowest keys go to test, the next to val, the rest
    to train; the per-class sizes come from :func:`split_quotas`.  With unique
    keys each row is compared with its class's two cut-off keys, so rows (and
    their text) are not shuffled; copies of a key need the full rank.
    """
    def quotas(sizes: DataFrame) -> DataFrame:
        return split_quotas(sizes, label).select(label, "n_test", "n_val")

    if unique_keys:
        d = materialize(df, "split-input") if materialize_input else df
        cuts = cutoff_keys(d, label, lambda sizes: quotas(sizes).select(
            label, "n_test", (F.col("n_test") + F.col("n_val")).alias("n_eval")), ["n_test", "n_eval"], key, eligible)
        elig = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
        part = (F.when(~elig | F.col("_cut_n_test").isNull(), F.lit(None))
                .when(F.col(key) < F.col("_cut_n_test"), F.lit("test"))
                .when(F.col(key) < F.col("_cut_n_eval"), F.lit("val")).otherwise(F.lit("train")))
        # one row per class; a shuffle by label would send all rows of a class to one task
        return d.join(F.broadcast(cuts), label, "left").withColumn(out, part).select(*d.columns, out)
    ranked = two_level_rank(df, [label], key, "_split_rank", eligible, per_stratum=quotas,
                            materialize_input=materialize_input, unique_keys=unique_keys)
    r = F.col("_split_rank")
    part = (F.when(r.isNull(), F.lit(None))
            .when(r < F.col("n_test"), F.lit("test"))
            .when(r < F.col("n_test") + F.col("n_val"), F.lit("val"))
            .otherwise(F.lit("train")))
    return ranked.withColumn(out, part).drop("_split_rank", "n_test", "n_val")


# ---------------------------------------------------------------------------
# M5 / M7 / M6
# ---------------------------------------------------------------------------

def dense_ids(df: DataFrame, by: Sequence[str] = ("split",), key: str = "row_key",
              out: str = "row_no", eligible: Column | None = None,
              materialize_input: bool = True, unique_keys: bool = True) -> DataFrame:
    """0-based position in key order within each ``by`` group (the shuffled order)."""
    return two_level_rank(df, list(by), key, out, eligible, materialize_input=materialize_input,
                          unique_keys=unique_keys)


def batch_size_for(split_col: str = "split", train: int = C.BATCH_SIZE,
                   other: int = 2 * C.BATCH_SIZE) -> Column:
    return F.when(F.col(split_col) == "train", F.lit(train)).otherwise(F.lit(other))


def minibatches(df: DataFrame, row_no: str = "row_no", size: Column | int = C.BATCH_SIZE,
                out: str = "batch_id") -> DataFrame:
    """``batch_id = floor(row_no / B)``; the last short batch is kept."""
    b = F.lit(size) if isinstance(size, int) else size
    return df.withColumn(out, F.floor(F.col(row_no) / b).cast("bigint"))


def preview(df: DataFrame, n: int = 5, key: str = "row_key") -> DataFrame:
    """The seeded n-row preview: the ``n`` lowest keys (a top-k, planned as TakeOrdered)."""
    return df.orderBy(key).limit(n)
