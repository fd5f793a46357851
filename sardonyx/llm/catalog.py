"""The registered queries of the training-data operators, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sardonyx.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    html_extract,
    lexical_search,
    lm_scores,
    mixing,
    quality,
    secret_scan,
    simhash,
    token_counts,
    token_store,
    url_rules,
)
from sardonyx.llm.bpe import load_json
from sardonyx.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: The vocabulary file of the token queries.
BYTE_BPE = "byte_bpe_50k.json"


def vocabulary(name: str = BYTE_BPE) -> str:
    """A public tokenizer's JSON; the files stay where they are installed."""
    import public_tokenizers

    return load_json(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op9_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_url_filters")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 7) == 2
    found = lm_scores.scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.withColumn("held_out", held_out)


@query("op8_token_store")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_digest(table(spark, sf_dir, "documents"), vocabulary())


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_secret_scans")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that a row's CRC-32 names (NULLs as one space)."""
    space = F.lit(" ")
    hit = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
                  .cast("binary")) % 20
    text, role = (F.coalesce(c, space) for c in ("text", "role"))
    return (conversations.withColumn("_hit", hit).where("_hit != 0").select(
        "conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
        .drop("_copy"))


#: Costs to the end as a recursion over turns; of equal costs the least letters.  Inserts before a row: none to two.
REPAIR_SQL = r"""
WITH RECURSIVE hits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(k)), lambda i: ascii(k[i + 1])::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda v, k: xor(v >> 1, (v & 1) * 3988292384::BIGINT))) AS crc
  FROM (SELECT *, concat_ws(':', coalesce(conv_id::VARCHAR, ' '), coalesce(turn::VARCHAR, ' ')) AS k FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM (SELECT *, xor(crc, 4294967295::BIGINT) % 20 AS hit FROM hits) WHERE hit <> 0),
numbered AS (
  SELECT *, row_number() OVER w AS t,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         lag(role[1]) OVER w || role[1] AS pair
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
turns AS (
  SELECT conv_id, turn, t, role, text, pair, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2
         WHEN body[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered),
inserts(q, q2, more, said, lines) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']),
  (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
  (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:']),
  (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:']), (3, 3, 10, 'II', ['user:', 'assistant:'])),
kept(q, letter, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
wanted(q, role, q2) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
edits AS (
  SELECT conv_id, t, q, q AS q2, 2 AS cost, 'D' AS said, []::VARCHAR[] AS lines FROM turns, range(4) AS r(q)
  UNION ALL SELECT conv_id, t, q, q2, CASE fault WHEN 3 THEN 5 ELSE 0 END, 'K', [role || ':' || text]
  FROM turns JOIN kept ON role[1] = letter WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, t, q, q2, CASE fault WHEN 3 THEN 6 ELSE 1 END, 'R', [wanted.role || ':' || text]
  FROM turns, wanted WHERE fault IN (0, 3)),
ways AS (
  SELECT conv_id, t, i.q, e.q2, more + cost AS cost, i.said || e.said AS said, i.lines || e.lines AS lines
  FROM edits e JOIN inserts i ON i.q2 = e.q),
best AS (
  SELECT conv_id, max(t) + 1 AS t, q, {'cost': any_value(more), 'audit': any_value(said), 'lines': any_value(lines)} AS b
  FROM turns, (SELECT q, more, said, lines FROM inserts
               WHERE (q, more) IN ((0, 0), (1, 10), (2, 5), (3, 0))) GROUP BY conv_id, q
  UNION ALL
  SELECT w.conv_id, w.t, w.q, min({'cost': w.cost + b.cost, 'audit': w.said || b.audit, 'lines': w.lines || b.lines})
  FROM best JOIN ways w ON w.conv_id IS NOT DISTINCT FROM best.conv_id AND w.t = best.t - 1 AND w.q2 = best.q
  GROUP BY w.conv_id, w.t, w.q),
found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM best WHERE t = 1 AND q = 0) b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = conversation_repair.audit(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    ids = conversations.select("conv_id").distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *[F.coalesce(c, empty.get(c, F.lit(0))).alias(c) for c in found.columns if c != "_id"])


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_lexical_search", rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")},
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::HUGEINT AS len FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all({LOWER.format("text")},
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
held AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total),
scores AS (SELECT item_id, h.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))))
             ::BIGINT AS score
           FROM asked JOIN held h USING (term) JOIN weights USING (term) JOIN sizes s ON s.doc_id = h.doc_id, total
           GROUP BY item_id, h.doc_id),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank,
                  doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
