"""Binding of the generated test tables to the pipeline's input roles.

The test tables carry no sarcasm data, so each role is bound to columns of
the given tables:

* headline-like rows: ``documents`` text, ``labels.quality`` as the label
  (LEFT join: unlabelled documents reach cleaning with a NULL label) and
  ``pages.url`` as the article link (page_id = doc_id, optional);
* forum-like rows: ``documents`` text, ``labels.quality`` as label,
  ``documents.source`` as the community name;
* fixed logits: ``embeddings.embedding`` dotted with constant vectors;
* hash scores for the metric operators: ``labels`` x ``documents``.

The real URL rules never fire on these URLs, so a bound rule list with
keywords that do occur is used next to them; the same holds for the lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.functions.numeric import dot_const, hash_unit
from sardonyx.functions.text import row_key

# Test bindings of the rule/lookup roles (ours; the data has no real keywords).
BOUND_URL_RULES = [
    ("/fr/", "politics"),
    ("//m.", "entertainment"),
    ("ref=", "technology"),
    ("blog", "sports"),
    (".org", "lifestyle"),
    (".net", "humor"),
]
BOUND_LOOKUP = {
    "src0": "politics", "src1": "politics",
    "src2": "entertainment", "src3": "entertainment",
    "src4": "technology", "src5": "technology",
    "src6": "sports", "src7": "sports",
    "src8": "lifestyle", "src9": "lifestyle",
    "src10": "humor", "src11": "humor",
    "src12": "general", "src13": "general",
}
EMBEDDING_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def headline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shaped like the headline source: ``row_id, headline, is_sarcastic, article_link``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return (docs.join(labels, "doc_id", "left").join(pages, "doc_id", "left")
            .select(F.col("doc_id").alias("row_id"), F.col("text").alias("headline"),
                    F.col("quality").alias("is_sarcastic"), F.col("url").alias("article_link")))


def forum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shaped like the forum CSV: ``row_id, label (text), comment, subreddit``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id", "inner")
            .select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("label"),
                    F.col("text").alias("comment"), F.col("source").alias("subreddit")))


def logit_weights(n_classes: int, dim: int = EMBEDDING_DIM, salt: int = 0) -> list[list[float]]:
    """Constant integer weight vectors ``w[k][j] = (j*(2k+3+salt) + k) % 9 - 4``."""
    return [[float((j * (2 * k + 3 + salt) + k) % 9 - 4) for j in range(dim)]
            for k in range(n_classes)]


SARCASM_WEIGHTS = logit_weights(2, salt=0)
DOMAIN_WEIGHTS = logit_weights(len(C.DOMAIN_LABELS), salt=5)


def logit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, sarc_label, domain_label, sarcasm_logits[2], domain_logits[7], row_key``."""
    emb = table(spark, sf_dir, "embeddings")
    sl = F.array(*[dot_const("embedding", w) for w in SARCASM_WEIGHTS])
    dl = F.array(*[dot_const("embedding", w) for w in DOMAIN_WEIGHTS])
    return emb.select(
        "vec_id",
        (F.col("label") % 2).cast("int").alias("sarc_label"),
        (F.col("label") % len(C.DOMAIN_LABELS)).cast("int").alias("domain_label"),
        sl.alias("sarcasm_logits"), dl.alias("domain_logits"),
        row_key(F.lit("emb"), F.col("vec_id")).alias("row_key"))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-scored labelled rows: ``doc_id, label, score, pred, domain`` (score in [0, 1))."""
    from sardonyx.operators.domains import with_domain_index, with_lookup_domain

    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    d = labels.join(docs, "doc_id", "left")
    d = with_lookup_domain(d, "source", "domain", BOUND_LOOKUP)
    d = with_domain_index(d, "domain", "domain_idx")
    score = F.lit(0.7) * hash_unit("doc_id") + F.lit(0.3) * F.col("quality").cast("double")
    return d.select("doc_id", F.col("quality").cast("int").alias("label"), score.alias("score"),
                    (score > F.lit(C.DECISION_THRESHOLD)).cast("int").alias("pred"),
                    "domain", "domain_idx")
