"""DuckDB SQL that states each query's result independently of the Spark plan.

The SQL is written the plain single-node way (global windows, list
functions); it is the correctness reference for the Spark jobs at small
scale.  Fragments are generated from the same constants as the Spark code.
"""

from __future__ import annotations

from collections.abc import Sequence

from sardonyx import config as C
from sardonyx.operators import permutation as PM
from sardonyx.sources.testbed import (BOUND_LOOKUP, BOUND_URL_RULES, DOMAIN_WEIGHTS,
                                      SARCASM_WEIGHTS)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in C.WHITESPACE) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def url_case(expr: str, rules: Sequence[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN contains(lower({expr}), {q(k)}) THEN {q(d)}" for k, d in rules)
    return f"(CASE {whens} ELSE {q(C.FALLBACK_DOMAIN)} END)"


def values_table(rows: Sequence[tuple], cols: Sequence[str]) -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


DOMAIN_DIM = values_table([(i, d) for i, d in enumerate(C.DOMAIN_LABELS)], ["domain_idx", "domain"])
DOMAIN_DIM_AS_DIM = DOMAIN_DIM.replace(" AS t(", " AS dim(")


def label_int(expr: str) -> str:
    return f"TRY_CAST(trunc(TRY_CAST({expr} AS DOUBLE)) AS INTEGER)"


def row_key(origin: str, ident: str) -> str:
    return f"md5('{C.SEED}|{origin}|' || CAST({ident} AS VARCHAR))"


def hash_unit(ident: str) -> str:
    return (f"(CAST(('0x' || substr(md5('{C.SEED}|' || CAST({ident} AS VARCHAR)), 1, 8)) AS BIGINT)"
            f"::DOUBLE / 4294967296.0::DOUBLE)")


def clean_cond(text: str, label: str, placeholders: bool) -> str:
    cond = (f"({text} IS NOT NULL AND {label} IS NOT NULL AND length({text}) > {C.MIN_TEXT_CHARS}"
            f" AND {label_int(label)} IS NOT NULL")
    if placeholders:
        cond += " AND " + text + " NOT IN (" + ", ".join(q(p) for p in C.PLACEHOLDER_TEXTS) + ")"
    return f"coalesce({cond}), FALSE)"


def quota_ctes(sizes: str, prefix: str) -> str:
    """CTEs ``{prefix}_quota(label, n, n_test, n_val, n_train)`` from ``sizes(label, n)``."""
    p = prefix
    return f"""
{p}_q1 AS (SELECT label, n, sum(n) OVER () AS nn FROM {sizes}),
{p}_q2 AS (SELECT *, nn - CAST(ceil({C.TEST_SPLIT!r}::DOUBLE * nn) AS BIGINT) AS r FROM {p}_q1),
{p}_q3 AS (SELECT *, CASE WHEN nn > 0 THEN CAST(CAST(n AS HUGEINT) * r AS DOUBLE) / CAST(nn AS DOUBLE) ELSE 0.0 END AS s1 FROM {p}_q2),
{p}_q4 AS (SELECT *, CAST(floor(s1) AS BIGINT) AS f1, s1 - floor(s1) AS m1 FROM {p}_q3),
{p}_q5 AS (SELECT *, f1 + CASE WHEN row_number() OVER (ORDER BY m1 DESC, label ASC)
                 <= r - sum(f1) OVER () THEN 1 ELSE 0 END AS rest FROM {p}_q4),
{p}_q6 AS (SELECT *, r - CAST(ceil({C.VAL_OF_REST!r}::DOUBLE * r) AS BIGINT) AS r2 FROM {p}_q5),
{p}_q7 AS (SELECT *, CASE WHEN r > 0 THEN CAST(CAST(rest AS HUGEINT) * r2 AS DOUBLE) / CAST(r AS DOUBLE) ELSE 0.0 END AS s2 FROM {p}_q6),
{p}_q8 AS (SELECT *, CAST(floor(s2) AS BIGINT) AS f2, s2 - floor(s2) AS m2 FROM {p}_q7),
{p}_q9 AS (SELECT *, f2 + CASE WHEN row_number() OVER (ORDER BY m2 DESC, label ASC)
                 <= r2 - sum(f2) OVER () THEN 1 ELSE 0 END AS n_train FROM {p}_q8),
{p}_quota AS (SELECT label, n, n - rest AS n_test, rest - n_train AS n_val, n_train FROM {p}_q9)"""


def corpus_ctes(max_samples: int | None = None) -> str:
    """CTEs ending in ``flagged`` (all raw rows + flags + split) and ``corpus`` (kept rows)."""
    quota = "class_n" if max_samples is None else f"least(class_n, {max_samples // 2})"
    lookup = values_table(sorted(BOUND_LOOKUP.items()), ["lookup_key", "lookup_domain"])
    return f"""
h_raw AS (
  SELECT d.doc_id AS row_id, d.text AS headline, l.quality AS is_sarcastic, p.url AS article_link
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN pages p ON p.page_id = d.doc_id),
h AS (
  SELECT 'headlines' AS origin, CAST(row_id AS BIGINT) AS row_id, {row_key('headlines', 'row_id')} AS row_key,
         {strip('CAST(headline AS VARCHAR)')} AS text, CAST(is_sarcastic AS VARCHAR) AS label_raw,
         {url_case('article_link', BOUND_URL_RULES)} AS domain, TRUE AS sampled
  FROM h_raw),
hk AS (SELECT *, {clean_cond('text', 'label_raw', False)} AS kept FROM h),
f_raw AS (
  SELECT d.doc_id AS row_id, CAST(l.quality AS VARCHAR) AS label, d.text AS comment, d.source AS subreddit
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
f_num AS (SELECT *, {row_key('forum', 'row_id')} AS row_key, TRY_CAST(label AS DOUBLE) AS label_num,
                 coalesce(TRY_CAST(label AS DOUBLE) IN (1.0, 0.0), FALSE) AS cap_elig FROM f_raw),
f_rank AS (SELECT *, row_number() OVER (PARTITION BY cap_elig, label_num ORDER BY row_key) - 1 AS rk,
                  count(*) OVER (PARTITION BY cap_elig, label_num) AS class_n FROM f_num),
f AS (
  SELECT 'forum' AS origin, CAST(row_id AS BIGINT) AS row_id, row_key, {strip('comment')} AS text,
         label AS label_raw, coalesce(t.lookup_domain, '{C.FALLBACK_DOMAIN}') AS domain,
         (cap_elig AND rk < {quota}) AS sampled
  FROM f_rank LEFT JOIN {lookup} ON t.lookup_key = {strip('f_rank.subreddit')}),
fk AS (SELECT *, sampled AND {clean_cond('text', 'label_raw', True)} AS kept FROM f),
u AS (SELECT * FROM hk UNION ALL SELECT * FROM fk),
ul AS (
  SELECT u.*, CASE WHEN kept THEN {label_int('label_raw')} END AS label,
         CAST(coalesce(dim.domain_idx, {C.GENERAL_INDEX}) AS INTEGER) AS domain_idx
  FROM u LEFT JOIN {DOMAIN_DIM_AS_DIM} ON dim.domain = u.domain),
sizes AS (SELECT label, count(*) AS n FROM ul WHERE kept GROUP BY label),
{quota_ctes('sizes', 'sp')},
ranked AS (
  SELECT ul.*, CASE WHEN kept THEN row_number() OVER (PARTITION BY kept, ul.label ORDER BY row_key) - 1 END AS srk
  FROM ul),
flagged AS (
  SELECT ranked.*, CASE WHEN srk IS NULL THEN NULL WHEN srk < qt.n_test THEN 'test'
                        WHEN srk < qt.n_test + qt.n_val THEN 'val' ELSE 'train' END AS split
  FROM ranked LEFT JOIN sp_quota qt ON qt.label = ranked.label),
corpus AS (
  SELECT origin, row_id, row_key, text, label, domain, domain_idx, split FROM flagged WHERE kept)
"""


def with_corpus(body: str, max_samples: int | None = None) -> str:
    return f"WITH {corpus_ctes(max_samples)} {body}"


def _dot(weights: Sequence[float]) -> str:
    w = "[" + ", ".join(f"{x!r}::DOUBLE" for x in weights) + "]"
    n = len(weights)
    return (f"list_reduce(list_transform(range({n}), lambda j: CAST(embedding[j + 1] AS DOUBLE) * {w}[j + 1]),"
            f" lambda a, b: a + b)")


def _lse(z: str) -> str:
    return f"(list_max({z}) + ln(list_reduce(list_transform({z}, lambda x: exp(x - list_max({z}))), lambda a, b: a + b)))"


def _softmax(z: str) -> str:
    total = f"list_reduce(list_transform({z}, lambda x: exp(x - list_max({z}))), lambda a, b: a + b)"
    return f"list_transform({z}, lambda x: exp(x - list_max({z})) / {total})"


def logits_ctes() -> str:
    """CTEs ``logits``, ``losses`` and ``preds`` over ``embeddings``."""
    sl = "[" + ", ".join(_dot(w) for w in SARCASM_WEIGHTS) + "]"
    dl = "[" + ", ".join(_dot(w) for w in DOMAIN_WEIGHTS) + "]"
    return f"""WITH logits AS (
  SELECT vec_id, CAST(label % 2 AS INTEGER) AS sarc_label,
         CAST(label % {len(C.DOMAIN_LABELS)} AS INTEGER) AS domain_label,
         {sl} AS sl, {dl} AS dl, {row_key('emb', 'vec_id')} AS row_key
  FROM embeddings),
losses AS (
  SELECT vec_id, sarc_label, domain_label, row_key,
         {_lse('sl')} - sl[sarc_label + 1] AS sarcasm_loss,
         {_lse('dl')} - dl[domain_label + 1] AS domain_loss,
         {C.SARCASM_LOSS_WEIGHT!r}::DOUBLE * ({_lse('sl')} - sl[sarc_label + 1])
           + {C.DOMAIN_LOSS_WEIGHT!r}::DOUBLE * ({_lse('dl')} - dl[domain_label + 1]) AS total_loss
  FROM logits),
probs AS (SELECT vec_id, {_softmax('sl')} AS sp, {_softmax('dl')} AS dp FROM logits),
preds AS (
  SELECT probs.*, CAST(list_position(dp, list_max(dp)) - 1 AS INTEGER) AS dom_idx, dim.domain AS dom_name
  FROM probs JOIN {DOMAIN_DIM_AS_DIM} ON dim.domain_idx = list_position(dp, list_max(dp)) - 1)
"""


def scored_ctes() -> str:
    """CTE ``scored(doc_id, label, score, pred, domain, domain_idx)`` from labels x documents."""
    lookup = values_table(sorted(BOUND_LOOKUP.items()), ["lookup_key", "lookup_domain"])
    return f"""WITH sbase AS (
  SELECT l.doc_id, l.quality, coalesce(t.lookup_domain, 'general') AS domain
  FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id
  LEFT JOIN {lookup} ON t.lookup_key = {strip('d.source')}),
scored AS (
  SELECT doc_id, CAST(quality AS INTEGER) AS label,
         0.7::DOUBLE * {hash_unit('doc_id')} + 0.3::DOUBLE * CAST(quality AS DOUBLE) AS score,
         CAST((0.7::DOUBLE * {hash_unit('doc_id')} + 0.3::DOUBLE * CAST(quality AS DOUBLE)) > 0.5 AS INTEGER) AS pred,
         sbase.domain, CAST(coalesce(dim.domain_idx, {C.GENERAL_INDEX}) AS INTEGER) AS domain_idx
  FROM sbase LEFT JOIN {DOMAIN_DIM_AS_DIM} ON dim.domain = sbase.domain)
"""


def class_stats_sql(src: str = "scored") -> str:
    def div(a, b):
        return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"
    return f"""
, cnt AS (SELECT count(CASE WHEN label = 0 AND pred = 0 THEN 1 END) AS tn,
                 count(CASE WHEN label = 0 AND pred = 1 THEN 1 END) AS fp,
                 count(CASE WHEN label = 1 AND pred = 0 THEN 1 END) AS fn,
                 count(CASE WHEN label = 1 AND pred = 1 THEN 1 END) AS tp,
                 count(CASE WHEN label NOT IN (0, 1) AND pred = 0 THEN 1 END) AS o0,
                 count(CASE WHEN label NOT IN (0, 1) AND pred = 1 THEN 1 END) AS o1 FROM {src}),
st AS (SELECT {div('tn', 'tn + fn + o0')} AS p0, {div('tn', 'tn + fp')} AS r0,
              {div('2 * tn', '2 * tn + fp + fn + o0')} AS f0,
              tn + fp AS s0, {div('tp', 'tp + fp + o1')} AS p1, {div('tp', 'tp + fn')} AS r1,
              {div('2 * tp', '2 * tp + fp + fn + o1')} AS f1, tp + fn AS s1,
              {div('tn + tp', 'tn + fp + fn + tp + o0 + o1')} AS acc, tn + fp + fn + tp + o0 + o1 AS total FROM cnt)
"""


def roc_groups_sql(src: str = "scored") -> str:
    return f"""
, rg AS (SELECT CAST(score AS DOUBLE) AS score, count(CASE WHEN label = 1 THEN 1 END) AS pos,
                count(CASE WHEN label <> 1 THEN 1 END) AS neg FROM {src}
       WHERE score IS NOT NULL AND NOT isnan(CAST(score AS DOUBLE)) AND label IS NOT NULL GROUP BY 1),
grp AS (SELECT score, pos, neg,
               CAST(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS tps,
               CAST(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS fps,
               lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg,
               lag(pos) OVER (ORDER BY score DESC) AS prev_pos,
               CAST(sum(pos) OVER () AS DOUBLE) AS n_pos, CAST(sum(neg) OVER () AS DOUBLE) AS n_neg FROM rg)
"""


def histogram_sql(src: str = "scored", bins: int = C.HISTOGRAM_BINS) -> str:
    nb = f"{float(bins)!r}::DOUBLE"

    def edge(i):
        return f"(CASE WHEN ({i}) >= {bins} THEN hi ELSE CAST({i} AS DOUBLE) * ((hi - lo) / {nb}) + lo END)"
    return f"""
, hs AS (SELECT label, min(CAST(score AS DOUBLE)) AS lo0, max(CAST(score AS DOUBLE)) AS hi0,
                count(score) AS total FROM {src} WHERE label IN (0, 1) AND score IS NOT NULL GROUP BY label),
hst AS (SELECT label, total, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
               CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM hs),
hrows AS (SELECT s.label, CAST(s.score AS DOUBLE) AS x, hst.lo, hst.hi FROM {src} s JOIN hst ON hst.label = s.label
          WHERE s.score IS NOT NULL),
hb0 AS (SELECT *, floor((x - lo) / (hi - lo) * {nb}) AS raw FROM hrows),
hb1 AS (SELECT *, CAST(CASE WHEN raw >= {bins} THEN {bins - 1} ELSE raw END AS INTEGER) AS i0 FROM hb0),
hb2 AS (SELECT *, CASE WHEN x < {edge('i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM hb1),
hb3 AS (SELECT *, CASE WHEN x >= {edge('i1 + 1')} AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS bin FROM hb2),
hcnt AS (SELECT label, bin, count(*) AS n FROM hb3 GROUP BY 1, 2),
hgrid AS (SELECT hst.*, unnest(range(0, {bins})) AS bin FROM hst),
hh AS (SELECT hgrid.label, hgrid.bin, hgrid.total, {edge('hgrid.bin')} AS lo_e, {edge('hgrid.bin + 1')} AS hi_e,
              CAST(coalesce(hcnt.n, 0) AS BIGINT) AS n
       FROM hgrid LEFT JOIN hcnt ON hcnt.label = hgrid.label AND hcnt.bin = hgrid.bin)
SELECT label, CAST(bin AS INTEGER) AS bin, round(lo_e, 6) AS bin_lo, round(hi_e, 6) AS bin_hi, n,
       round(CAST(n AS DOUBLE) / (hi_e - lo_e) / CAST(total AS DOUBLE), 6) AS density,
       0.5::DOUBLE AS decision_threshold FROM hh"""


TOKEN_RE = C.TOKEN_SPLIT_REGEX


def tokens_sql(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '{TOKEN_RE}'), lambda x: x <> '')"


def vocab_ctes(size: int = C.VOCAB_SIZE) -> str:
    return f"""
, vt AS (SELECT unnest({tokens_sql('text')}) AS token FROM corpus WHERE split = 'train'),
vc AS (SELECT token, count(*) AS n FROM vt GROUP BY token),
vr AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token ASC) AS rn FROM vc),
voc AS (SELECT token, n, CAST(rn + {C.FIRST_TOKEN_ID - 1} AS INTEGER) AS token_id FROM vr
        WHERE rn <= {size - C.FIRST_TOKEN_ID})"""


def encoded_ctes(max_len: int = C.MAX_SEQ_LENGTH) -> str:
    k = max_len - 2
    return vocab_ctes() + f"""
, et AS (SELECT origin, row_id, split, label, domain_idx, {tokens_sql('text')} AS toks FROM corpus),
ex AS (SELECT origin, row_id, split, label, domain_idx, CAST(len(toks) AS INTEGER) AS n_tokens,
              list_slice(toks, 1, {k}) AS kept FROM et),
ux AS (SELECT origin, row_id, unnest(kept) AS token, unnest(range(1, len(kept) + 1)) AS pos FROM ex),
idl AS (SELECT ux.origin, ux.row_id, list(coalesce(voc.token_id, {C.UNK_ID}) ORDER BY pos) AS ids
        FROM ux LEFT JOIN voc ON voc.token = ux.token GROUP BY 1, 2),
enc AS (SELECT ex.origin, ex.row_id, split, label, domain_idx, n_tokens,
               [{C.CLS_ID}] || coalesce(idl.ids, []) || [{C.SEP_ID}]
                 || list_transform(range({k} - len(coalesce(idl.ids, []))), lambda x: {C.PAD_ID}) AS input_ids,
               list_transform(range(len(coalesce(idl.ids, [])) + 2), lambda x: 1)
                 || list_transform(range({k} - len(coalesce(idl.ids, []))), lambda x: 0) AS attention_mask
        FROM ex LEFT JOIN idl ON idl.origin = ex.origin AND idl.row_id = ex.row_id)"""


def history_ctes(epochs: int = C.NUM_EPOCHS) -> str:
    """CTE ``hist`` (unrounded history) of the fixed-logit path; needs ``logits_ctes``."""
    def div(a, b):
        return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"
    zs = (f"list_transform(sl, lambda z, i: z * (CAST(epoch AS DOUBLE) / {float(epochs)!r}::DOUBLE)"
          f" + CASE WHEN i = 2 THEN CAST(2 - epoch AS DOUBLE) * 0.25::DOUBLE ELSE 0.0::DOUBLE END)")
    zd = f"list_transform(dl, lambda z: z * (CAST(epoch AS DOUBLE) / {float(epochs)!r}::DOUBLE))"
    metrics = ["loss", "sarc_loss", "acc", "f1"]
    cols = ", ".join(f"max(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}"
                     for s in ("train", "val") for m in metrics)
    return f"""
, esz AS (SELECT sarc_label AS label, count(*) AS n FROM logits GROUP BY 1),
{quota_ctes('esz', 'eq')},
esplit AS (
  SELECT l.*, CASE WHEN rk < q.n_test THEN 'test' WHEN rk < q.n_test + q.n_val THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY sarc_label ORDER BY row_key) - 1 AS rk FROM logits) l
  JOIN eq_quota q ON q.label = l.sarc_label),
ebatch AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY row_key) - 1)
         / CASE WHEN split = 'train' THEN {C.BATCH_SIZE} ELSE {2 * C.BATCH_SIZE} END) AS BIGINT) AS batch_id
  FROM esplit),
eep AS (SELECT *, unnest(range(1, {epochs + 1})) AS epoch FROM ebatch WHERE split IN ('train', 'val')),
ez AS (SELECT epoch, split, batch_id, sarc_label, domain_label, {zs} AS zs, {zd} AS zd FROM eep),
eloss AS (SELECT epoch, split, batch_id, sarc_label, {_lse('zs')} - zs[sarc_label + 1] AS s_loss,
                 {_lse('zd')} - zd[domain_label + 1] AS d_loss,
                 CAST(list_position(zs, list_max(zs)) - 1 AS INTEGER) AS pred FROM ez),
eb AS (SELECT epoch, split, batch_id,
              avg({C.SARCASM_LOSS_WEIGHT!r}::DOUBLE * s_loss + {C.DOMAIN_LOSS_WEIGHT!r}::DOUBLE * d_loss) AS t,
              avg(s_loss) AS s,
              count(CASE WHEN sarc_label = 0 AND pred = 0 THEN 1 END) AS tn,
              count(CASE WHEN sarc_label = 0 AND pred = 1 THEN 1 END) AS fp,
              count(CASE WHEN sarc_label = 1 AND pred = 0 THEN 1 END) AS fn,
              count(CASE WHEN sarc_label = 1 AND pred = 1 THEN 1 END) AS tp FROM eloss GROUP BY 1, 2, 3),
es AS (SELECT epoch, split, avg(t) AS loss, avg(s) AS sarc_loss, sum(tn) AS tn, sum(fp) AS fp,
              sum(fn) AS fn, sum(tp) AS tp FROM eb GROUP BY 1, 2),
es2 AS (SELECT epoch, split, loss, sarc_loss, {div('tn + tp', 'tn + fp + fn + tp')} AS acc,
               {div(f"{div('2 * tn', '2 * tn + fp + fn')} * (tn + fp) + {div('2 * tp', '2 * tp + fp + fn')} * (tp + fn)",
                    'tn + fp + fn + tp')} AS f1 FROM es),
hist AS (SELECT CAST(epoch AS INTEGER) AS epoch, {cols}, CAST(NULL AS DOUBLE) AS epoch_time_sec
         FROM es2 GROUP BY epoch)"""


def epoch_order_ctes(rows: str, seed: int = C.SEED) -> str:
    """CTE ``shuffled`` = ``rows(..., row_no, n, epoch)`` with the row's ``position`` in the epoch's order.

    The same bijection as ``operators.permutation``, one CTE per half round.
    """
    ctes = [f"""
o0 AS (SELECT *, row_no AS x, CAST(floor(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a,
              n // CAST(floor(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS b FROM {rows})"""]
    last = "o0"
    for w in range(PM.WINDOWS):
        at = "0" if w % 2 == 0 else "n - a * b"
        ctes.append(f"w{w} AS (SELECT *, {at} AS low, (x - ({at})) // b AS l, (x - ({at})) % b AS r FROM {last})")
        last = f"w{w}"
        for h in range(PM.HALF_ROUNDS):
            number = w * PM.HALF_ROUNDS + h
            digit, other, size = ("r", "l", "a") if h % 2 == 0 else ("l", "r", "b")
            t = (f"(({digit} * {PM.MULTIPLIER} + epoch * 362437 + {PM.round_key(seed, number)})"
                 f" % {PM.LARGE_PRIME} % {PM.SMALL_PRIME})")
            ctes.append(f"h{number} AS (SELECT * REPLACE (({other} + ({t} * {t}) % {PM.LARGE_PRIME}) % {size} AS {other}) FROM {last})")
            last = f"h{number}"
        ctes.append(f"x{w} AS (SELECT * EXCLUDE (x, low, l, r), CASE WHEN x >= low AND x < low + a * b"
                    f" THEN l * b + r + low ELSE x END AS x FROM {last})")
        last = f"x{w}"
    ctes.append(f"shuffled AS (SELECT * EXCLUDE (x, a, b), x AS position FROM {last})")
    return ",\n".join(ctes)
