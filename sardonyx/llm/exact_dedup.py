"""Exact dedup with a heavy-hitter split; DataFrame functions only.

Texts are compared by SHA-256 of their UTF-8 bytes (NULL counts as the empty
text).  A Misra-Gries pass (``freqItems``: at most ``1/support`` counters for
each task and for the merged result) names every digest that may hold more
than ``support`` of all rows.  The candidates are verified by an exact count,
and the winners (at most ``1/support`` rows of one digest, one count and one
id) are broadcast: the rows of a hot group meet their winner on the map side
and are never shuffled.  The other digests, each below ``support`` of the
rows, go through an ordinary partially aggregated shuffle.

Defined results: of equal texts the row with the largest ``doc_id`` stays, a
NULL id ranks below all others, and rows that repeat both text and id are told
apart by a row handle, so exactly one row of a group stays.  An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sardonyx.llm.common import keep_rows, stored, with_row

#: A digest with more than this share of the rows counts as heavy; its inverse bounds the broadcast.
SUPPORT = 0.001


def _groups(digests: DataFrame) -> DataFrame:
    """One row per digest: its size and the row that stays."""
    return digests.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_keep"))


def exact_groups(rows: DataFrame, text: str = "text", support: float = SUPPORT) -> DataFrame:
    """``doc_id, _row, keep_id, group_size, kept, text_sha256`` for rows that carry ``_row``."""
    digests = stored(rows.select(
        "doc_id", "_row",
        F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_digest")), "digests")
    counted = digests.freqItems(["_digest"], support)
    candidates = counted.select(F.explode("_digest_freqItems").alias("_digest")).distinct()
    exact = _groups(digests.join(F.broadcast(candidates), "_digest"))
    # at most 1/support digests can pass this test, whatever the table
    winners = stored(exact.where(F.col("group_size") > digests.count() * support), "heavy-digests")
    heavy = digests.join(F.broadcast(winners), "_digest")
    rest = digests.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    light = rest.join(_groups(rest), "_digest")
    return heavy.unionByName(light).select(
        "doc_id", "_row", F.col("_keep.doc_id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"), F.col("_digest").alias("text_sha256"))


def dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, lambda rows: exact_groups(rows, support=support), "dedup-input")


def decisions(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document, dropped ones too: which row of its group stays."""
    return exact_groups(with_row(docs.select("doc_id", "text")), support=support).drop("_row")
