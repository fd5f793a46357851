"""A dense shared vector: randomised truncated SVD of a sparse feature table.

The table's rows (TF-IDF vectors of ``d`` features) stay where they are.  A pass
multiplies them by a ``d x l`` sketch that every task has: with ``A`` the table
it returns ``A^T A G``, summed per feature, which is ``d x l`` whatever the number
of rows.  Subspace iteration on that product finds the leading right singular
vectors ``V``: a random start, ``power`` passes to sharpen it, one pass to read
the singular values off.  ``l = rank + OVERSAMPLE``; the driver holds ``d x l`` numbers
(a parameter, not a size of the data), a task those and a block of rows.

``projection`` gives the linear stage ``x -> V^T x`` as a Spark ML model, so
scoring stays in the JVM and is saved with its pipeline.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERSAMPLE = 16
POWER = 2
#: Cells of the dense block of rows that a task multiplies at a time (16 MB).
CELLS = 1 << 21


class Svd(NamedTuple):
    """``components``: d x rank, columns of unit length; ``values``: singular values, largest first."""

    components: np.ndarray
    values: np.ndarray
    rows: int


def sparse_rows(df: DataFrame, features: str = "features") -> DataFrame:
    """``idx, val`` of a sparse vector column."""
    v = F.unwrap_udt(features)
    return df.select(v["indices"].alias("idx"), v["values"].alias("val")).where(F.size("idx") > 0)


def gram_product(rows: DataFrame, sketch: np.ndarray) -> np.ndarray:
    """``A^T A sketch`` for the rows ``idx, val`` of ``A``: one pass, one partial sum per task and feature."""
    d, width = sketch.shape
    step = max(1, CELLS // d)
    box = rows.sparkSession.sparkContext.broadcast(sketch)

    def work(batches):
        g, total = box.value, np.zeros((d, width))
        for b in batches:
            at, idx = b.column(0).offsets.to_numpy().astype(np.int64), b.column(0).values.to_numpy()
            val = b.column(1).values.to_numpy()
            for i in range(0, b.num_rows, step):
                cut = at[i:i + step + 1]
                x = np.zeros((len(cut) - 1, d))
                x[np.repeat(np.arange(len(x)), np.diff(cut)), idx[cut[0]:cut[-1]]] = val[cut[0]:cut[-1]]
                total += x.T @ (x @ g)
        there = np.flatnonzero(total.any(axis=1))
        flat = pa.array(total[there].ravel())
        ends = pa.array(np.arange(0, len(flat) + 1, width), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.ListArray.from_arrays(ends, flat)], ["j", "z"])

    parts = rows.select("idx", "val").mapInArrow(work, "j int, z array<double>")
    sums = parts.groupBy("j").agg(*[F.sum(F.col("z")[k]).alias(f"z{k}") for k in range(width)]).toArrow()
    out = np.zeros((d, width))
    if sums.num_rows:
        out[sums.column("j").to_numpy()] = np.column_stack([sums.column(f"z{k}").to_numpy() for k in range(width)])
    return out


def truncated_svd(rows: DataFrame, d: int, rank: int, power: int = POWER, seed: int = 42) -> Svd:
    """The leading ``rank`` right singular vectors and singular values of the rows ``idx, val``."""
    width = min(d, rank + OVERSAMPLE)
    rank = min(rank, d)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))
    for _ in range(power):
        q, _ = np.linalg.qr(gram_product(rows, q))
    t = q.T @ gram_product(rows, q)
    values, turn = np.linalg.eigh((t + t.T) / 2)
    top = np.argsort(values)[::-1][:rank]
    v = q @ turn[:, top]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(rank)] < 0, -1.0, 1.0)  # a direction has no sign of its own
    return Svd(v, np.sqrt(np.maximum(values[top], 0.0)), rows.count())


def projection(spark: SparkSession, svd: Svd, input_col: str, output_col: str, even: bool = True):
    """The model ``x -> V^T x``; with ``even`` each component has a mean square of 1 over the rows.

    Components without variance (a table of fewer rows than ``rank``) give 0.
    """
    from pyspark.ml.common import _py2java
    from pyspark.ml.feature import PCAModel
    from pyspark.ml.linalg import DenseMatrix, DenseVector

    largest = svd.values.max(initial=0.0)
    seen = svd.values > 1e-9 * largest
    scale = np.sqrt(max(svd.rows, 1)) / np.where(seen, svd.values, 1.0) if even else np.ones(len(svd.values))
    matrix = svd.components * np.where(seen, scale, 0.0)
    energy = svd.values ** 2
    sc = spark.sparkContext
    # Spark has the model (a fixed matrix applied to vectors) but fits it only by a d x d covariance
    java = sc._jvm.org.apache.spark.ml.feature.PCAModel(
        f"shared_vector_{matrix.shape[0]}x{matrix.shape[1]}",
        _py2java(sc, DenseMatrix(*matrix.shape, matrix.ravel(order="F"))),
        _py2java(sc, DenseVector(energy / max(energy.sum(), 1e-300))))
    model = PCAModel(java)
    model._set(k=matrix.shape[1], inputCol=input_col, outputCol=output_col)
    return model
