"""P14 + I9: sessions that a stop word ends, over micro-batches and restarts.

Each conversation is a session.  When a row's text is the stop word (any case,
white space around it), the session ends at that row's turn: the row itself and
all later turns are dropped, in this micro-batch and in every later one.  The
turn at which a session ended is keyed state of the query, so it is kept in the
query's checkpoint and holds after a restart.

Turns are the order; a NULL turn comes before all others.  A row that arrived in
an earlier micro-batch than its session's stop word has been passed on already,
whatever its turn.  Within a micro-batch the function sees one session's rows of
that batch, so a trigger (``maxFilesPerTrigger``) bounds what it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from sardonyx import config as C
from sardonyx.functions.text import strip_ws

#: The turn that stands for NULL.
FIRST = -(1 << 63)


def is_stop(text: str = "text", word: str = C.STOP_WORD) -> Column:
    return F.coalesce(F.lower(strip_ws(F.col(text).cast("string"))) == F.lit(word), F.lit(False))


def open_rows(rows: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The rows of a batch table before their session's first stop word; no row moves but for a join
    with one row per ended session."""
    key, turn = F.col(session), F.coalesce(F.col(order).cast("bigint"), F.lit(FIRST))
    ends = rows.filter(is_stop(text)).groupBy(key.alias("_session")).agg(F.min(turn).alias("_end"))
    d = rows.join(ends, key.eqNullSafe(F.col("_session")), "left")
    return d.filter(F.col("_end").isNull() | (turn < F.col("_end"))).select(rows.columns)


def open_stream(stream: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The rows of a stream before their session's stop word (columns of plain types)."""
    fields = stream.schema.fields
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in fields):
        raise TypeError("columns of plain types are needed")
    # as text, which holds every plain value and NULL on the way through pandas
    packed = stream.select(
        *[F.col(f.name).cast("string").alias(f"c{k}") for k, f in enumerate(fields)],
        F.coalesce(F.col(session).cast("string"), F.lit("")).alias("_session"), F.col(session).isNull().alias("_none"),
        F.coalesce(F.col(order).cast("bigint"), F.lit(FIRST)).alias("_turn"), is_stop(text).alias("_stop"))
    columns = [f"c{k}" for k in range(len(fields))]

    def passed(key, frames, state):
        frames = list(frames)
        ends = [int(f["_turn"][f["_stop"]].min()) for f in frames if f["_stop"].any()]
        if state.exists:
            ends.append(state.get[0])
        if ends:
            state.update((min(ends),))
        for f in frames:
            yield f[columns] if not ends else f.loc[f["_turn"] < min(ends), columns]

    out = packed.groupBy("_session", "_none").applyInPandasWithState(
        passed, ", ".join(f"{c} string" for c in columns), "ended bigint", "append", GroupStateTimeout.NoTimeout)
    return out.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(columns, fields)])
