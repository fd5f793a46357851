"""URL verdicts: a host and path rule list first, then mined association rules.

Host and path are cut from the url by column functions.  A list rule fits its
host and all subdomains if the url's path starts with the rule's; the longest
fitting rule decides.  Every other url is judged by association rules: a url is a
set of tokens (scheme, host labels and their parts, path parts, query keys), a
labelled url has its label as one more item, and each frequent set with the
block label becomes a rule ``tokens -> block``.  Sets of one or two tokens are
counted one by one and need no share of the labels, so that a bad host of a few
pages has its rule on tables of any size; larger ones come from Spark's FP-growth
over the blocked urls.  Tokens too rare among those for a rule, and tokens that
cannot change one, are left out first, so thirty path parts that always stand
together are one token and not 2^30 sets.
Rules below the confidence limit go, as do rules that a shorter rule with at
least the same confidence covers.  Matching uses an inverted index: a rule is
filed under its rarest token only, each url looks its own tokens up, and a hit
must hold all the rule's tokens.  A url without a matching rule is allowed.

A label blocks a url if its quality is 0 or it is toxic.  A rule needs
``LEAST_COUNT`` blocked urls, so a handful of labels yields no rule; a set of
three or more tokens also needs the share ``SUPPORT`` of the labelled urls.

Defined results: NULL urls, or urls without ``://``, have empty host and path
and are allowed; rows that repeat an id get a row each; a label that has only
NULLs is no label; empty label tables yield no mined rules; only ``page_id``
and ``url`` of the pages are read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sardonyx.llm.common import stored, with_row

# ---- fixed values: the rule list (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT = 0.002
LEAST_COUNT = 25
CONFIDENCE = 0.8
#: Rows of a table of tokens or rules that may be broadcast (some 20 MB).
SMALL = 100_000
BLOCK = "label=block"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule of a given list; NULL where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest goes outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The url's distinct tokens, each marked with its part of the url; digits count as one token."""
    def parts(x: Column, pattern: str, mark: str) -> Column:
        found = F.filter(F.split(x, pattern), lambda t: t != "")
        return F.transform(found, lambda t: F.concat(
            F.lit(mark), F.when(t.rlike("^[0-9]+$"), F.lit("#")).otherwise(t)))

    safe = F.coalesce(url, F.lit(""))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(safe, r"^([^:/?#]*)://", 1))))
    query = F.regexp_replace(F.regexp_extract(safe, r"\?([^#]*)", 1), "=[^&]*", "")
    return F.array_distinct(F.concat(
        scheme, parts(host, r"\.", "host="), parts(host, r"[.\-_]", "word="),
        parts(F.lower(path), r"[/.\-_]", "path="), parts(F.lower(query), "&", "query=")))


def labelled_urls(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """``tokens`` of each labelled url, the block label as one more token."""
    bad = F.max(
        F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(),
               (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)))
    known = labels.groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("_bad")).where("_bad is not null")
    return urls.join(known, "page_id").select(
        F.when(F.col("_bad"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))


def frequent_tokens(rows: DataFrame, least: int) -> DataFrame:
    """``token, choices, n_all, n_bad`` of the tokens with at least ``least`` blocked urls.

    Tokens that stand in exactly the same labelled urls are one token with several
    ``choices``: no rule needs two of them, and any of them may stand for it.
    """
    single = rows.select("_row", "bad", F.explode("tokens").alias("token"))
    ones = single.groupBy("token").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum("bad").alias("n_bad"),
        # equal sets of rows have equal sums; 128 bits tell different ones apart
        F.bit_xor(F.xxhash64("_row")).alias("h"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("g"))
    return ones.where(F.col("n_bad") >= least).groupBy("n_all", "n_bad", "h", "g").agg(
        F.min("token").alias("token"), F.array_sort(F.collect_set("token")).alias("choices")).select(
        "token", "choices", "n_all", "n_bad")


def reduced_urls(rows: DataFrame, able: DataFrame) -> DataFrame:
    """``_row, bad, t`` of the urls with at least two of the tokens in ``able``, sorted."""
    able = able.select("token")
    if able.count() <= SMALL:
        able = F.broadcast(able)
    found = rows.select("_row", "bad", F.explode("tokens").alias("token")).join(able, "token")
    return found.groupBy("_row", "bad").agg(F.array_sort(F.collect_set("token")).alias("t")).where(F.size("t") > 1)


def pairs_of(reduced: DataFrame, least: int) -> DataFrame:
    """``tokens, n_all, n_bad`` of the sets of two tokens with at least ``least`` blocked urls."""
    ones = reduced.select("bad", "t", F.posexplode("t").alias("at", "a"))
    pairs = ones.select("bad", "a", F.explode(F.slice("t", F.col("at") + 2, F.size("t"))).alias("b"))
    return (pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_all"), F.sum("bad").alias("n_bad"))
            .where(F.col("n_bad") >= least).select(F.array("a", "b").alias("tokens"), "n_all", "n_bad"))


def filed(sets: DataFrame, ones: DataFrame) -> DataFrame:
    """``sets`` with ``key``, the rarest of each set's ``tokens``."""
    keys = (sets.select("tokens", F.explode("tokens").alias("token"))
            .join(ones.select("token", F.col("n_all").alias("f")), "token")
            .groupBy("tokens").agg(F.min_by("token", F.struct("f", "token")).alias("key")))
    return sets.join(keys, "tokens")


def long_sets(reduced: DataFrame, ones: DataFrame, floor: int) -> DataFrame:
    """``tokens, n_all, n_bad`` of the sets of three or more tokens with ``floor`` blocked urls, by FP-growth.

    Only the blocked urls are mined, since a rule has no other support; all urls are then counted for the sets found.
    """
    from pyspark.ml.fpm import FPGrowth

    bad = stored(reduced.where("bad = 1 and size(t) > 2").select(F.col("t").alias("items")), "url-blocked")
    n = bad.count()
    if n < floor:
        return reduced.sparkSession.createDataFrame([], "tokens array<string>, n_all bigint, n_bad bigint")
    found = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / n).fit(bad).freqItemsets
    found = stored(found.where(F.size("items") > 2).select(
        F.array_sort("items").alias("tokens"), F.col("freq").alias("n_bad")), "url-itemsets")
    index = filed(found, ones).select("key", "tokens", "n_bad")
    hits = reduced.select("t", F.explode("t").alias("key")).join(index, "key").where(
        F.size(F.array_except("tokens", "t")) == 0)
    return hits.groupBy("tokens").agg(F.count(F.lit(1)).alias("n_all"), F.max("n_bad").alias("n_bad"))


def mine(transactions: DataFrame, support: float = SUPPORT, least: int = LEAST_COUNT,
         confidence: float = CONFIDENCE) -> DataFrame:
    """``key, tokens, choices, n, rule_support, rule_confidence``: pruned rules, filed under their rarest token.

    What no pruned rule can hold is not combined: a token that blocks every url it stands in (alone it
    covers all larger sets), one that stands in every url (it changes no count), and a second token of
    those that stand in the same urls.
    """
    rows = stored(with_row(transactions).select(
        "_row", F.array_contains("items", BLOCK).cast("int").alias("bad"),
        F.array_remove("items", BLOCK).alias("tokens")), "url-transactions")
    total = rows.count()
    ones = stored(frequent_tokens(rows, least), "url-tokens")
    reduced = stored(reduced_urls(rows, ones.where((F.col("n_bad") < F.col("n_all")) & (F.col("n_all") < total))),
                     "url-reduced")
    sets = (ones.select(F.array("token").alias("tokens"), "n_all", "n_bad")
            .unionByName(pairs_of(reduced, least))
            .unionByName(long_sets(reduced, ones, max(least, math.ceil(support * total)))))
    rules = sets.withColumn("rule_confidence", F.col("n_bad") / F.col("n_all")).where(F.col("rule_confidence") >= confidence)
    rules = stored(rules.select("tokens", F.size("tokens").alias("n"),
                                (F.col("n_bad") / total).alias("rule_support"), "rule_confidence"), "url-rules-all")
    # a shorter rule covers a longer one: look each one-token-smaller set up (itemsets are closed downwards)
    smaller = rules.where("n > 1").select("tokens", "rule_confidence", F.explode("tokens").alias("out")).select(
        F.col("tokens").alias("whole"), "rule_confidence", F.array_remove("tokens", F.col("out")).alias("tokens"))
    covered = smaller.join(rules.select("tokens", F.col("rule_confidence").alias("c")), "tokens").where(
        F.col("c") >= F.col("rule_confidence")).select(F.col("whole").alias("tokens")).distinct()
    kept = filed(rules.join(covered, "tokens", "left_anti"), ones)
    choices = (kept.select("tokens", F.explode("tokens").alias("token")).join(ones.select("token", "choices"), "token")
               .groupBy("tokens").agg(F.collect_list("choices").alias("choices")))
    return kept.join(choices, "tokens").select("key", "tokens", "choices", "n", "rule_support", "rule_confidence")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``_row`` and its ``_best`` rule of the urls (``_row, tokens``) that hold one of each of a rule's choices."""
    alike = F.filter("choices", lambda c: F.array_contains(c, F.col("key")))[0]
    index = stored(rules.withColumn("key", F.explode(alike)), "url-index")
    keys = index.select("key").distinct()
    if index.count() <= SMALL:
        keys, index = F.broadcast(keys), F.broadcast(index)
    # tokens that no rule is filed under are not moved
    mine_ = urls.select("_row", F.col("tokens").alias("_mine"), F.explode("tokens").alias("key")).join(keys, "key", "left_semi")
    hits = mine_.join(index, "key").where(F.forall("choices", lambda c: F.arrays_overlap(c, F.col("_mine"))))
    return hits.groupBy("_row").agg(F.max(F.struct(
        "rule_confidence", "rule_support", F.array_join("tokens", " ").alias("mined"))).alias("_best"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT,
          least: int = LEAST_COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule, mined_confidence`` of every page."""
    parted = with_row(pages.select("page_id", "url")).withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    urls = stored(parted.select("_row", "page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"),
                                tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    rules_found = mine(labelled_urls(urls, labels), support, least, confidence)
    best = matched(urls.where("listed is null").select("_row", "tokens"), rules_found)
    return urls.join(best, "_row", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("_best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("_best.mined").alias("mined_rule"), F.col("_best.rule_confidence").alias("mined_confidence"))
