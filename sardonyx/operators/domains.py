"""Domain assignment: ordered URL rules, exact lookup tables, index <-> name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.functions.text import strip_ws


def domain_dimension(spark: SparkSession, labels: Sequence[str] = C.DOMAIN_LABELS) -> DataFrame:
    """The fixed ``(domain_idx, domain)`` table (as many rows as labels)."""
    return spark.createDataFrame([(i, d) for i, d in enumerate(labels)],
                                 "domain_idx int, domain string")


def lookup_table(spark: SparkSession, lookup: dict[str, str] = C.COMMUNITY_LOOKUP) -> DataFrame:
    return spark.createDataFrame(sorted(lookup.items()), "lookup_key string, lookup_domain string")


def with_lookup_domain(df: DataFrame, key_col: str, out: str = "domain",
                       lookup: dict[str, str] | DataFrame = C.COMMUNITY_LOOKUP,
                       fallback: str = C.FALLBACK_DOMAIN) -> DataFrame:
    """Exact, case-sensitive key after stripping; anything else -> ``fallback``.

    A dict is a dimension table of its own size and joined with a broadcast
    hint; of a given DataFrame the size is unknown, so the planner decides.
    """
    spark = df.sparkSession
    dim = lookup_table(spark, lookup) if isinstance(lookup, dict) else lookup
    dim = dim.withColumnRenamed("lookup_key", "_lookup_key")
    keyed = df.withColumn("_lookup_key", strip_ws(F.col(key_col).cast("string")))
    joined = keyed.join(F.broadcast(dim) if isinstance(lookup, dict) else dim, on="_lookup_key", how="left")
    out_col = F.coalesce(F.col("lookup_domain"), F.lit(fallback))
    return joined.withColumn(out, out_col).drop("_lookup_key", "lookup_domain")


def with_domain_index(df: DataFrame, domain_col: str = "domain", out: str = "domain_idx",
                      labels: Sequence[str] = C.DOMAIN_LABELS,
                      fallback_index: int = C.GENERAL_INDEX) -> DataFrame:
    """P10: name -> index through the fixed dimension; unknown/NULL -> index of ``general``."""
    dim = domain_dimension(df.sparkSession, labels).withColumnRenamed("domain", "_dim_domain")
    joined = df.join(F.broadcast(dim).withColumnRenamed("domain_idx", "_dim_idx"),
                     df[domain_col] == F.col("_dim_domain"), "left")
    return (joined.withColumn(out, F.coalesce(F.col("_dim_idx"), F.lit(fallback_index)).cast("int"))
            .drop("_dim_idx", "_dim_domain"))


def domain_name(idx_col, labels: Sequence[str] = C.DOMAIN_LABELS):
    """Index -> name, in the row (``element_at`` of the fixed label array)."""
    c = F.col(idx_col) if isinstance(idx_col, str) else idx_col
    return F.element_at(F.array(*[F.lit(x) for x in labels]), c.cast("int") + 1)
