"""Canonical projection and row cleaning (strip, null drop, length, label cast, placeholders)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.functions.text import label_to_int, strip_ws


def clean_condition(text: Column, label_raw: Column,
                    placeholders: Sequence[str] | None = None,
                    min_chars: int = C.MIN_TEXT_CHARS) -> Column:
    """True when a row survives cleaning.  ``text`` must already be stripped.

    Rows with NULL text or label are dropped, as are texts of ``min_chars``
    code points or fewer and (forum only) exact placeholder texts.  A label
    that is not a number is dropped as well (it cannot be cast).
    """
    cond = (text.isNotNull() & label_raw.isNotNull()
            & (F.char_length(text) > F.lit(min_chars))
            & label_to_int(label_raw).isNotNull())
    if placeholders:
        cond = cond & ~text.isin(list(placeholders))
    return F.coalesce(cond, F.lit(False))
