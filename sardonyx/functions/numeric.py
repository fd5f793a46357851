"""Numeric expressions over arrays of logits.

Spark's higher-order functions (``transform``, ``aggregate``, ``zip_with``)
are evaluated without whole-stage codegen, so when the array width is known
(2 sarcasm classes, 7 domains, a fixed weight vector) the expressions are
unrolled into plain element arithmetic, which is code-generated.  The
higher-order forms remain for arrays of unknown width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sardonyx import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _items(a: Column, n: int) -> list[Column]:
    return [a.getItem(i) for i in range(n)]


def hash_unit(ident, seed: int = C.SEED) -> Column:
    """Uniform value in [0, 1) from the first 8 hex digits of ``md5('<seed>|<id>')``."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), _col(ident).cast("string")))
    as_int = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return as_int.cast("double") / F.lit(4294967296.0)


def dot_const(arr: str, weights: Sequence[float]) -> Column:
    """Dot product of an array column with a constant vector, summed left to right.

    Unrolled into one SQL expression (parsed once in the JVM, code-generated)
    instead of a per-element lambda.
    """
    if not weights:
        return F.lit(0.0)
    name = "`" + arr.replace("`", "``") + "`"
    terms = [f"CAST({name}[{j}] AS DOUBLE) * CAST({float(w)!r} AS DOUBLE)" for j, w in enumerate(weights)]
    return F.expr(" + ".join(terms))


def _sum(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def logsumexp(arr, n: int | None = None) -> Column:
    a = _col(arr)
    if n:
        z = _items(a, n)
        m = F.greatest(*z) if n > 1 else z[0]
        return m + F.log(_sum([F.exp(x - m) for x in z]))
    m = F.array_max(a)
    return m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def softmax(arr, n: int | None = None) -> Column:
    """Numerically stable softmax of an array column (unrolled when ``n`` is given)."""
    a = _col(arr)
    if n:
        z = _items(a, n)
        m = F.greatest(*z) if n > 1 else z[0]
        e = [F.exp(x - m) for x in z]
        total = _sum(e)
        return F.array(*[x / total for x in e])
    m = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return F.transform(a, lambda x: F.exp(x - m) / total)


def cross_entropy(arr, label, n: int | None = None) -> Column:
    """``logsumexp(z) - z[y]`` for a 0-based class index ``y``."""
    return logsumexp(arr, n) - F.element_at(_col(arr), _col(label).cast("int") + 1)


def argmax(arr) -> Column:
    """0-based index of the largest value; ties go to the lowest index."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
