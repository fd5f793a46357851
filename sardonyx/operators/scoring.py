"""Predictions from the two heads: scores, flags, argmax domain, score maps, ranked domains, cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.functions.numeric import argmax
from sardonyx.operators.domains import domain_name


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def predictions(df: DataFrame, sarcasm_probs="sarcasm_probs", domain_probs="domain_probs",
                keep: Sequence[str] = (), labels: Sequence[str] = C.DOMAIN_LABELS) -> DataFrame:
    """The prediction record of each row, from the two probability arrays.

    ``is_sarcastic`` compares the *unrounded* score with 0.5 (strict); scores
    are then rounded to 4 decimals; the domain is the argmax (lowest index on
    ties); the score map lists every domain in label order.
    """
    sp, dp = _col(sarcasm_probs), _col(domain_probs)
    score = F.element_at(sp, 2)
    idx = argmax(dp)
    names = F.array(*[F.lit(x) for x in labels])
    rounded = F.array(*[F.round(dp.getItem(i), 4) for i in range(len(labels))])
    return df.select(
        *keep,
        F.round(score, 4).alias("sarcasm_score"),
        (score > F.lit(C.DECISION_THRESHOLD)).alias("is_sarcastic"),
        domain_name(idx, labels).alias("domain"),
        F.round(F.element_at(dp, idx + 1), 4).alias("domain_confidence"),
        F.map_from_arrays(names, rounded).alias("all_domain_scores"),
    )


def ranked_domain_scores(df: DataFrame, domain_probs="domain_probs", keep: Sequence[str] = (),
                         labels: Sequence[str] = C.DOMAIN_LABELS) -> DataFrame:
    """M8 (+ the 20-cell bars of I10): domains ranked by rounded score, ties in label order.

    The sort stays inside the row (``sort_array`` of structs) and is then
    exploded, so no shuffle is needed.
    """
    dp = _col(domain_probs)
    names = F.array(*[F.lit(x) for x in labels])
    keyed = F.array(*[F.struct((-F.round(dp.getItem(i), 4)).alias("k"), F.lit(i).alias("idx"),
                               F.round(dp.getItem(i), 4).alias("score")) for i in range(len(labels))])
    d = df.select(*keep, F.posexplode(F.sort_array(keyed)).alias("pos", "e"))
    cells = F.floor(F.col("e.score") * C.DOMAIN_BAR_CELLS).cast("int")
    return d.select(
        *keep, F.element_at(names, F.col("e.idx") + 1).alias("domain"),
        F.col("e.score").alias("score"), (F.col("pos") + 1).cast("int").alias("rank"),
        F.concat(F.repeat(F.lit(C.BAR_FULL), cells),
                 F.repeat(F.lit(C.BAR_EMPTY), F.lit(C.DOMAIN_BAR_CELLS) - cells)).alias("bar"))


def percent_text(x: Column) -> Column:
    """One-decimal percent of a 4-decimal fraction, half-up on the basis points (e.g. '45.7%')."""
    bp = F.round(x * 10000).cast("bigint")
    tenths = F.floor((bp + 5) / 10).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))


def score_cards(pred: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Verdict, 30-cell score bar, upper-cased domain, percent confidence, 4-dp score text."""
    cells = F.floor(F.col("sarcasm_score") * C.SCORE_BAR_CELLS).cast("int")
    return pred.select(
        *keep,
        F.when(F.col("is_sarcastic"), F.lit(C.VERDICT_YES)).otherwise(F.lit(C.VERDICT_NO)).alias("verdict"),
        F.concat(F.repeat(F.lit(C.BAR_FULL), cells),
                 F.repeat(F.lit(C.BAR_EMPTY), F.lit(C.SCORE_BAR_CELLS) - cells)).alias("score_bar"),
        F.format_string("%.4f", F.col("sarcasm_score")).alias("score_text"),
        F.upper("domain").alias("domain_upper"),
        percent_text(F.col("domain_confidence")).alias("confidence_text"),
    )


def prompt_guard(df: DataFrame, text: str = "text", min_chars: int = C.MIN_PROMPT_CHARS) -> DataFrame:
    """Strip free text; drop the stop word (any case) and texts under ``min_chars``.

    The stop word ends an interactive session and is never scored; on a
    stream, ending the session is stopping the query.
    """
    from sardonyx.functions.text import strip_ws
    d = df.withColumn(text, strip_ws(F.col(text).cast("string")))
    return d.filter((F.lower(F.col(text)) != F.lit(C.STOP_WORD)) & (F.char_length(text) >= min_chars))
