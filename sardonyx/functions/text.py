"""String expressions: stripping, label casting, rule-based domains, keys, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sardonyx import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c, chars: str = C.WHITESPACE) -> Column:
    """Strip all Unicode whitespace at both ends (plain ``trim`` only strips spaces)."""
    return F.btrim(_col(c), F.lit(chars))


def label_to_int(c) -> Column:
    """Integer label; numeric text is truncated (``'1.9'`` -> 1), junk becomes NULL."""
    return _col(c).cast("string").try_cast("double").try_cast("int")


def url_domain(c, rules: Sequence[tuple[str, str]] = C.URL_RULES,
               fallback: str = C.FALLBACK_DOMAIN) -> Column:
    """First rule keyword contained in the lower-cased URL wins; NULL/no hit -> fallback."""
    low = F.lower(_col(c))
    expr = None
    for keyword, domain in rules:
        cond = low.contains(keyword)
        expr = F.when(cond, F.lit(domain)) if expr is None else expr.when(cond, F.lit(domain))
    return F.lit(fallback) if expr is None else expr.otherwise(F.lit(fallback))


def row_key(origin, ident, seed: int = C.SEED) -> Column:
    """Repeatable row key ``md5('<seed>|<origin>|<id>')``: independent of partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), _col(origin).cast("string"),
                             _col(ident).cast("string")))


def tokens(c, pattern: str = C.TOKEN_SPLIT_REGEX) -> Column:
    """Lower-case word tokens of the whole text (runs of letters/digits)."""
    parts = F.split(F.lower(_col(c)), pattern, -1)
    return F.array_remove(parts, "")
