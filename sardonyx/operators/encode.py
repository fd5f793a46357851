"""Corpus vocabulary and fixed-length id/mask encoding (+ shape checks).

The vocabulary is a word count over the train split (partial aggregation
before the shuffle, so a very frequent token costs one row per partition),
cut to a fixed size: it is bounded by that size and can be broadcast.
Encoding tokenises the whole text, keeps the first ``max_len - 2`` tokens
(the encoder's truncation) and looks their ids up inside the array: the
vocabulary is one constant, a list of small maps by the token's hash, so no
token is exploded, shuffled or regrouped.  A vocabulary too large for a
constant is joined instead, which regroups the ids per row.

Sub-words of a given vocabulary are cut in Arrow batches of word lists: a batch
holds few distinct words, so each is cut once and the ids are put in place as
whole columns.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from sardonyx import config as C
from sardonyx.functions.text import tokens
from sardonyx.session import materialize

#: Tokens of a vocabulary that is carried as a constant (a few MB); a larger one is joined.
CONSTANT_TOKENS = 65_536
#: Maps in that constant; each holds a handful of tokens, since a map is searched from its start.
BUCKETS = 1 << 13
#: Characters up to which every length of a sub-word piece is tried; longer ones are found by their first characters.
PIECE_CHARS = 16

#: Leading characters that split a tie of equally frequent tokens.
PREFIX = 3


def build_vocabulary(df: DataFrame, text: str = "text", size: int = C.VOCAB_SIZE) -> DataFrame:
    """``token, n, token_id``; most frequent first (ties by token), ids from 4 up.

    A plain ``orderBy().limit(V)`` would send every partition's local top V
    to one merge task.  Instead, a histogram of the counts (one row per
    distinct count value, small) finds the count values that can still reach
    the top V: those with fewer than V tokens counted strictly above them (at
    most V values, so that table may be broadcast).  All but the lowest of
    them fit as a whole.  The lowest may be a large tie (all words seen once):
    of it only the first tokens in order are wanted, and a count per leading
    ``PREFIX`` characters tells which prefixes they can have.  So what reaches
    the final sort are V tokens and the rest of one prefix.
    """
    n_words = size - C.FIRST_TOKEN_ID
    counts = (df.select(F.explode(tokens(text)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    counts = materialize(counts, "word-counts")   # read by the histogram, the prefixes and the result
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_k"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    reachable = (hist.withColumn("_above", F.coalesce(F.sum("_k").over(above), F.lit(0)))
                 .filter(F.col("_above") < n_words))   # at most n_words rows
    reached = counts.join(F.broadcast(reachable), "n").withColumn("_prefix", F.substring("token", 1, PREFIX))
    # tokens before each (count, prefix) in the final order; a prefix that starts beyond V is not wanted
    ahead = Window.partitionBy("n").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (reached.filter("_above + _k > " + str(n_words)).groupBy("n", "_above", "_prefix")
              .agg(F.count(F.lit(1)).alias("_p"))
              .withColumn("_before", F.col("_above") + F.coalesce(F.sum("_p").over(ahead), F.lit(0)))
              .filter(F.col("_before") < n_words).select("n", "_prefix"))
    survivors = (reached.filter("_above + _k <= " + str(n_words)).select("token", "n")
                 .unionByName(reached.join(wanted, ["n", "_prefix"], "left_semi")
                              .filter("_above + _k > " + str(n_words)).select("token", "n")))
    top = survivors.orderBy(F.desc("n"), F.asc("token")).limit(n_words)   # bounded by ``size``
    order = Window.orderBy(F.desc("n"), F.asc("token"))
    return top.select("token", "n", (F.row_number().over(order) + C.FIRST_TOKEN_ID - 1)
                      .cast("int").alias("token_id"))


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS))


def id_lookup(vocab: DataFrame):
    """``token -> id`` (NULL if unknown) as a column function over a constant of the whole vocabulary."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    # at most CONSTANT_TOKENS rows
    for r in vocab.select(_bucket(F.col("token")).alias("b"), "token", "token_id").collect():
        maps[r["b"]][r["token"]] = r["token_id"]
    constant = F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), "array<map<string,int>>")
    return lambda t: F.element_at(F.element_at(constant, (_bucket(t) + 1).cast("int")), t)


def tokenizer_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``token, token_id`` of a public tokenizer's JSON file (``model.vocab``), read by Spark."""
    vocab = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,int>")
    return spark.read.text(path, wholetext=True).select(F.explode(vocab).alias("token", "token_id"))


def piece_cutter(known, most: int, unknown: int, continued: str = "", end: str = "", head: int = PIECE_CHARS):
    """A function from lists of words to the first ``most`` ids of each list's pieces.

    A word's pieces are the longest matches first from the left, or ``[unknown]`` if some rest has none.
    ``known`` is the broadcast ``token -> id``; ``continued`` stands before a piece that does not start
    its word in the vocabulary (``##``), ``end`` after one that ends it (``</w>``).  More than ``head``
    characters are tried where a piece of that length begins with the same ``head``, up to the longest such piece.
    """
    reach: dict[str, int] = {}   # of the longer pieces: their first characters -> characters of the longest
    for lead in {"", continued}:
        for token in filter(None, known.value):
            if token.startswith(lead) and len(token) > len(lead) + head:
                first = token[:len(lead) + head]
                reach[first] = max(reach.get(first, 0), len(token) - len(lead))

    def of_word(word, ids):
        out, at = [], 0
        while at < len(word):
            lead = continued if at else ""
            most_chars = reach.get(lead + word[at:at + head], head)
            for stop in range(min(at + most_chars, len(word)), at, -1):
                piece = ids.get(lead + word[at:stop] + (end if stop == len(word) else ""))
                if piece is not None:
                    out.append(piece)
                    at = stop
                    break
            else:
                return [unknown]
        return out or [unknown]

    def of_lists(words: pa.Array) -> pa.Array:
        flat = words.flatten().dictionary_encode()   # each distinct word of the batch is cut once
        cut = [of_word(w, known.value) for w in flat.dictionary.to_pylist()]
        sizes = np.array([len(c) for c in cut], np.int64)
        starts, ids = np.cumsum(sizes) - sizes, np.array([i for c in cut for i in c], np.int32)
        word = flat.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[word])])
        lists = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
        first = ends[lists[:-1]]   # a list's pieces, among those of all lists
        kept = np.minimum(ends[lists[1:]] - first, most)
        bounds = np.concatenate([[0], np.cumsum(kept)])
        place = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], kept)
        at = np.searchsorted(ends, place, side="right") - 1
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids[starts[word[at]] + place - ends[at]], pa.int32()))

    return of_lists


def encode_pieces(df: DataFrame, pieces: DataFrame, keys: Sequence[str], text: str = "text",
                  max_len: int = C.MAX_SEQ_LENGTH, carry: Sequence[str] = (), continued: str = "", end: str = "",
                  unknown: int = 0, first: int = 0, last: int = 0, pad: int = 0) -> DataFrame:
    """T1-T4 in sub-words: ``input_ids[max_len]`` and ``attention_mask[max_len]`` over a given vocabulary.

    The words are those of the corpus vocabulary; a row's ids are the pieces of its words up to
    ``max_len - 2``, between ``first`` and ``last``.  The pieces must fit a constant.
    """
    if pieces.limit(CONSTANT_TOKENS + 1).count() > CONSTANT_TOKENS:
        raise ValueError(f"more than {CONSTANT_TOKENS} pieces do not fit a constant")
    room = max_len - 2
    # at most CONSTANT_TOKENS rows
    known = df.sparkSession.sparkContext.broadcast({r["token"]: r["token_id"] for r in pieces.collect()})
    cut = piece_cutter(known, room, unknown, continued, end)

    def cut_batches(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], cut(b.column("_words"))], [*b.schema.names[:-1], "_ids"])

    # every word has a piece at least, so the first ``room`` words hold the first ``room`` pieces
    words = F.slice(F.coalesce(tokens(text), F.array().cast("array<string>")), 1, room)
    t = df.select(*keys, *carry, words.alias("_words"))
    kinds = StructType([*t.schema.fields[:-1], StructField("_ids", ArrayType(IntegerType()))])
    t = t.mapInArrow(cut_batches, kinds)
    input_ids, mask = _framed(F.col("_ids"), max_len, first, last, pad)
    return t.select(*keys, *carry, input_ids.alias("input_ids"), mask.alias("attention_mask"))


def _framed(ids: Column, max_len: int, first: int = C.CLS_ID, last: int = C.SEP_ID,
            fill: int = C.PAD_ID) -> tuple[Column, Column]:
    """``input_ids`` and ``attention_mask`` of at most ``max_len - 2`` token ids."""
    n = F.size(ids)
    pad = F.lit(max_len - 2) - n
    return (F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last)), F.array_repeat(F.lit(fill), pad)),
            F.concat(F.array_repeat(F.lit(1), n + 2), F.array_repeat(F.lit(0), pad)))


def encode(df: DataFrame, vocab: DataFrame, keys: Sequence[str], text: str = "text",
           max_len: int = C.MAX_SEQ_LENGTH, carry: Sequence[str] = ()) -> DataFrame:
    """``input_ids[max_len]``, ``attention_mask[max_len]``, ``n_tokens`` per row.

    ``keys`` identify a row; ``carry`` columns are kept.  Unknown tokens map
    to UNK; rows without tokens (and NULL texts) encode as ``[CLS, SEP, PAD...]``.
    """
    keep = [*keys, *carry]
    if vocab.limit(CONSTANT_TOKENS + 1).count() > CONSTANT_TOKENS:
        return _encode_by_join(df, vocab, keep, text, max_len)
    look_up = id_lookup(vocab)
    t = df.select(*keep, tokens(text).alias("_toks"))
    none = F.array().cast("array<int>")
    ids = F.transform(F.slice("_toks", 1, max_len - 2), lambda x: F.coalesce(look_up(x), F.lit(C.UNK_ID)))
    t = t.select(*keep, F.size("_toks").alias("n_tokens"), F.coalesce(ids, none).alias("_ids"))
    input_ids, mask = _framed(F.col("_ids"), max_len)
    return t.select(*keep, "n_tokens", input_ids.alias("input_ids"), mask.alias("attention_mask"))


def _encode_by_join(df: DataFrame, vocab: DataFrame, keep: Sequence[str], text: str, max_len: int) -> DataFrame:
    """The encoding by a join of single tokens, for vocabularies of any size."""
    # Tokenise once per row (the array feeds both the count and the explode).  The
    # regroup is keyed by a per-row handle taken in the same map stage (stable on a
    # task retry), so rows with NULL or repeated keys never merge.
    t = df.select(*keep, tokens(text).alias("_toks"), F.monotonically_increasing_id().alias("_rid"))
    t = t.select(*keep, "_rid", F.size("_toks").alias("n_tokens"),
                 F.slice("_toks", 1, max_len - 2).alias("_kept"))
    d = t.select(*keep, "_rid", "n_tokens", F.posexplode_outer("_kept").alias("pos", "token"))
    j = d.join(vocab.select("token", "token_id"), "token", "left")
    pair = F.when(F.col("pos").isNotNull(),
                  F.struct("pos", F.coalesce("token_id", F.lit(C.UNK_ID)).alias("id")))
    g = j.groupBy("_rid").agg(F.array_sort(F.collect_list(pair)).alias("_pairs"),
                              *[F.first(c).alias(c) for c in [*keep, "n_tokens"]])
    input_ids, mask = _framed(F.col("_pairs.id"), max_len)   # field of every struct, in position order
    return g.select(*keep, "n_tokens", input_ids.alias("input_ids"), mask.alias("attention_mask"))


def encoding_violations(enc: DataFrame, max_len: int = C.MAX_SEQ_LENGTH) -> DataFrame:
    """Per rule, the number of encoded rows that break it (all zero when well formed)."""
    ids, mask = F.col("input_ids"), F.col("attention_mask")
    ones = F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    rules = {
        "ids_length": F.size(ids) != max_len,
        "mask_length": F.size(mask) != max_len,
        "mask_binary": F.exists(mask, lambda x: ~x.isin(0, 1)),
        "mask_prefix": F.exists(F.sequence(F.lit(1), F.lit(max_len - 1)),
                                lambda i: F.element_at(mask, i + 1) > F.element_at(mask, i)),
        "cls_first": F.element_at(ids, 1) != C.CLS_ID,
        "sep_after_tokens": F.element_at(ids, ones) != C.SEP_ID,
        "pad_where_masked": F.exists(F.arrays_zip(ids, mask),
                                     lambda z: (z["attention_mask"] == 0) & (z["input_ids"] != C.PAD_ID)),
    }
    agg = enc.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count(F.when(c, 1)).alias(k) for k, c in rules.items()])
    return agg.unpivot("n_rows", list(rules), "rule", "n_violations").select(
        "rule", "n_rows", F.col("n_violations").cast("bigint").alias("n_violations"))
