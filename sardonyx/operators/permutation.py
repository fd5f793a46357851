"""A new order of a numbered table for every epoch, as column arithmetic.

Shuffling a split again for each epoch would rank all its rows again.  Here
the rows keep one number (``row_no`` in ``[0, n)``) and an epoch is a keyed
bijection of ``[0, n)``: the position of a row in epoch ``e`` is computed from
its number alone, so nothing moves and any epoch can be asked for by itself.

The bijection: with ``a = floor(sqrt(n))`` and ``b = floor(n / a)`` a number
below ``a*b`` is a pair of digits ``(x div b, x mod b)``, and Feistel rounds add
a keyed function of one digit to the other, modulo ``a`` and ``b`` in turn.
The fewer than ``a`` numbers left over take part because the window of ``a*b``
numbers is laid at the start, then at the end, then at the start again.  Each
window is a bijection of its own, so no row is ever drawn twice and no number
has to be drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.operators.ranking import batch_size_for, minibatches

#: Half rounds in a window; an even number, so both digits change equally often.
HALF_ROUNDS = 4
WINDOWS = 3
#: Fixed numbers of the round function: a multiplier, and primes below 2^31 and 2^32.
MULTIPLIER, SMALL_PRIME, LARGE_PRIME = 2654435761, 2147483647, 4294967291


def round_key(seed: int, number: int) -> int:
    """The key of a half round, without the epoch's part."""
    return (seed * 1_000_003 + number * 7_368_787 + 12_345) % SMALL_PRIME


def _mixed(digit: Column, epoch: Column, seed: int, number: int) -> Column:
    """A keyed function of a digit (below 2^31), without overflow: digits stay below some 3e9."""
    key = epoch.cast("bigint") * F.lit(362_437) + F.lit(round_key(seed, number))
    t = (digit * F.lit(MULTIPLIER) + key) % F.lit(LARGE_PRIME) % F.lit(SMALL_PRIME)
    return (t * t) % F.lit(LARGE_PRIME)


def epoch_position(df: DataFrame, n: str, epoch: str, row_no: str = "row_no", out: str = "position",
                   seed: int = C.SEED) -> DataFrame:
    """Add the 0-based position of every row in its epoch's order.

    ``n`` names the column with the size of the row's group (whose numbers are
    ``0 .. n-1``), ``epoch`` the column with the epoch.  NULL numbers stay NULL.
    """
    d = df.withColumns({"_x": F.col(row_no).cast("bigint"), "_n": F.col(n).cast("bigint"),
                        "_a": F.floor(F.sqrt(F.col(n).cast("double"))).cast("bigint")})
    d = d.withColumn("_b", F.floor(F.col("_n") / F.col("_a")).cast("bigint"))
    for w in range(WINDOWS):
        # the window starts at 0, or so that it ends at n
        d = d.withColumn("_at", F.lit(0) if w % 2 == 0 else F.col("_n") - F.col("_a") * F.col("_b"))
        y = F.col("_x") - F.col("_at")
        inside = (y >= 0) & (y < F.col("_a") * F.col("_b"))
        d = d.withColumns({"_in": inside, "_l": F.floor(y / F.col("_b")).cast("bigint"),
                           "_r": F.pmod(y, F.col("_b"))})
        for h in range(HALF_ROUNDS):
            number = w * HALF_ROUNDS + h
            if h % 2 == 0:
                d = d.withColumn("_l", (F.col("_l") + _mixed(F.col("_r"), F.col(epoch), seed, number)) % F.col("_a"))
            else:
                d = d.withColumn("_r", (F.col("_r") + _mixed(F.col("_l"), F.col(epoch), seed, number)) % F.col("_b"))
        d = d.withColumn("_x", F.when(F.col("_in"), F.col("_l") * F.col("_b") + F.col("_r") + F.col("_at"))
                         .otherwise(F.col("_x")))
    return d.withColumn(out, F.col("_x")).drop("_x", "_n", "_a", "_b", "_at", "_in", "_l", "_r")


def epoch_minibatches(df: DataFrame, epochs: int, n: str = "n", split: str = "split",
                      row_no: str = "row_no", seed: int = C.SEED) -> DataFrame:
    """Every row once per epoch with ``epoch, position, batch_id``: train rows in the epoch's own
    order, the rows of other splits in the order of their numbers."""
    d = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    d = epoch_position(d, n, "epoch", row_no, "_shuffled", seed)
    d = d.withColumn("position", F.when(F.col(split) == "train", F.col("_shuffled")).otherwise(F.col(row_no))).drop("_shuffled")
    return minibatches(d, "position", batch_size_for(split))
