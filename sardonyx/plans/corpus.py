"""The labelled corpus: two sources -> cap -> clean -> union -> domain index -> split.

``flagged_corpus`` keeps every raw row with flags (``sampled``, ``kept``) and
the ``split`` of kept rows, so row counts of every stage come from one
aggregate over one pass instead of one job per stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.functions.text import label_to_int, row_key, strip_ws, url_domain
from sardonyx.operators.clean import clean_condition
from sardonyx.operators.domains import with_domain_index, with_lookup_domain
from sardonyx.operators.ranking import class_cap, stratified_split

FLAG_COLUMNS = ["origin", "row_id", "row_key", "text", "label_raw", "domain", "sampled", "kept"]


def _key(origin: str, rid, content, seed: int):
    """Row key from the id when the source has one, else from the row's content.

    Rows with equal content get equal keys, so any order among them yields
    the same multiset of results.
    """
    by_content = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(origin),
                                   *[F.coalesce(c.cast("string"), F.lit("")) for c in content]))
    return F.when(rid.isNotNull(), row_key(F.lit(origin), rid, seed)).otherwise(by_content)


def flag_headlines(rows: DataFrame, url_rules: Sequence[tuple[str, str]] = C.URL_RULES,
                   origin: str = "headlines", seed: int = C.SEED) -> DataFrame:
    """Headline rows (``row_id, headline, is_sarcastic[, article_link]``) with flags.

    No cap and no placeholder rule on this source; a missing link column gives
    the fallback domain.
    """
    link = F.col("article_link") if "article_link" in rows.columns else F.lit(None).cast("string")
    text = strip_ws(F.col("headline").cast("string"))
    rid = F.col("row_id").cast("bigint") if "row_id" in rows.columns else F.lit(None).cast("bigint")
    return rows.select(
        F.lit(origin).alias("origin"), rid.alias("row_id"),
        _key(origin, rid, [F.col("headline"), F.col("is_sarcastic"), link], seed).alias("row_key"),
        text.alias("text"), F.col("is_sarcastic").cast("string").alias("label_raw"),
        url_domain(link, url_rules).alias("domain"), F.lit(True).alias("sampled"),
    ).withColumn("kept", clean_condition(F.col("text"), F.col("label_raw")))


def flag_forum(rows: DataFrame, lookup: dict[str, str] = C.COMMUNITY_LOOKUP,
               max_samples: int | None = None, origin: str = "forum",
               seed: int = C.SEED, unique_keys: bool = False) -> DataFrame:
    """Forum rows (``row_id, label, comment, subreddit``), cleaned; with ``max_samples`` an
    exact per-class cap comes first.  ``unique_keys``: every row has its own ``row_id``."""
    rid = F.col("row_id").cast("bigint") if "row_id" in rows.columns else F.lit(None).cast("bigint")
    d = rows.select(
        F.lit(origin).alias("origin"), rid.alias("row_id"),
        _key(origin, rid, [F.col("comment"), F.col("label"), F.col("subreddit")], seed).alias("row_key"),
        F.col("comment").cast("string").alias("comment"),
        F.col("label").cast("string").alias("label_raw"), "subreddit",
        F.col("label").cast("string").try_cast("double").alias("_label_num"))
    # The cap's size pass needs only ids and labels (column pruning), so the
    # join below it is cheaper to read twice than to write out.
    d = class_cap(d, "_label_num", max_samples, classes=(1.0, 0.0), materialize_input=False,
                  unique_keys=unique_keys)
    d = with_lookup_domain(d, "subreddit", "domain", lookup)
    text = strip_ws(F.col("comment"))
    return d.select(
        "origin", "row_id", "row_key", text.alias("text"), "label_raw", "domain", "sampled",
    ).withColumn("kept", F.col("sampled") & clean_condition(
        F.col("text"), F.col("label_raw"), C.PLACEHOLDER_TEXTS))


def flagged_corpus(headlines: DataFrame | None, forum: DataFrame | None,
                   unique_keys: bool = False) -> DataFrame:
    """Union of flagged sources + ``label``, ``domain_idx`` and the stratified ``split``.

    ``unique_keys=True`` when every source carries row ids (no content keys,
    so no key is shared by copies); the default also handles copies.
    """
    parts = [p.select(*FLAG_COLUMNS) for p in (headlines, forum) if p is not None]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    d = d.withColumn("label", F.when(F.col("kept"), label_to_int("label_raw")))
    d = with_domain_index(d, "domain", "domain_idx")
    return stratified_split(d, "label", "row_key", eligible=F.col("kept"), unique_keys=unique_keys)


def corpus(flagged: DataFrame) -> DataFrame:
    """The labelled corpus: kept rows only, ``origin,row_id,row_key,text,label,domain,domain_idx,split``."""
    return flagged.filter("kept").select("origin", "row_id", "row_key", "text", "label",
                                         "domain", "domain_idx", "split")


def stage_counts(flagged: DataFrame) -> DataFrame:
    """Row counts per source and stage (raw, sampled, clean, train, val, test) + combined.

    One aggregate (with a rollup for the combined row) over the flagged rows.
    """
    agg = flagged.rollup("origin").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count(F.when(F.col("sampled"), 1)).alias("sampled"),
        F.count(F.when(F.col("kept"), 1)).alias("clean"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train"),
        F.count(F.when(F.col("split") == "val", 1)).alias("val"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test"),
    ).withColumn("origin", F.coalesce(F.col("origin"), F.lit("combined")))
    stages = ["raw", "sampled", "clean", "train", "val", "test"]
    return agg.unpivot("origin", stages, "stage", "n").select(
        "origin", "stage", F.col("n").cast("bigint").alias("n"))
