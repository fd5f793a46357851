"""Token counts without ids: each distinct pre-token is counted once.

1. Every task counts the pre-tokens of its texts and Spark sums the partial
   counts, giving the corpus table ``piece, n``; the tokenizer gives each
   distinct piece its number of ids, once.
2. Every document's pre-token frequencies meet that table.  The most frequent
   pieces (at most ``HEAD_PIECES`` of at most ``HEAD_CHARS`` characters, so a
   few MB whatever the corpus) are broadcast and summed where the text is
   read, and so are the MD5 sums of the ``HEAD_LONG`` most frequent longer ones
   (separator lines): no piece so frequent that it would be a hot join key is
   shuffled.  The other frequencies are joined by piece and summed per document.

Nothing holds the ids of a text.  Defined results: a NULL or empty text has 0
bytes and 0 tokens; rows that repeat an id are counted as rows of their own;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from hashlib import md5
from itertools import compress, repeat
from operator import not_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sardonyx.llm.bpe import encoder
from sardonyx.llm.common import PieceLists, arrow_map, stored, texts_of, with_row

HEAD_PIECES = 131_072
HEAD_CHARS = 64
HEAD_LONG = 16_384
#: A task hands partial counts on when it holds this many distinct pieces.
FLUSH_PIECES = 150_000


def piece_counts(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """``piece, n``: how often each pre-token occurs in all texts."""
    box = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def flush(seen: Counter):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
            ["piece", "n"])

    def count(batches):
        enc, seen = encoder(box.value), Counter()
        for batch in batches:
            for text in texts_of(batch):
                seen.update(enc.pieces(text.decode()))
                if len(seen) >= FLUSH_PIECES:
                    yield flush(seen)
                    seen = Counter()
        if seen:
            yield flush(seen)

    parts = arrow_map(docs.select("text"), count, "piece string, n bigint")
    return parts.groupBy("piece").agg(F.sum("n").alias("n"))


def with_token_counts(pieces: DataFrame, tokenizer_json: str) -> DataFrame:
    """``piece, n, k``: the number of ids of each distinct piece."""
    box = pieces.sparkSession.sparkContext.broadcast(tokenizer_json)

    def ask(batches):
        enc = encoder(box.value)
        for b in batches:
            k = [enc.count_of(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k, pa.int64())],
                                             ["piece", "n", "k"])

    return arrow_map(pieces.select("piece", "n"), ask, "piece string, n bigint, k bigint")


def _above_level(pieces: DataFrame, most: int) -> DataFrame:
    """The pieces above a count level that at most ``most`` of them reach."""
    level = F.floor(F.log2("n") * 8).cast("int")
    # at most 8 x 63 levels
    sizes = pieces.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, lowest = 0, 1 << 30
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        lowest = r["level"]
    return pieces.where(level >= lowest)


def frequent_pieces(pieces: DataFrame, most: int = HEAD_PIECES) -> DataFrame:
    """The most frequent of the short pieces, ``most`` at most."""
    return _above_level(pieces.where(F.length("piece") <= HEAD_CHARS), most)


def frequent_long(pieces: DataFrame, value: str, most: int = HEAD_LONG) -> dict[bytes, int]:
    """``value`` of the most frequent of the longer pieces by their MD5 sum, ``most`` at most."""
    long = _above_level(pieces.where(F.length("piece") > HEAD_CHARS), most)
    return {bytes(r["h"]): r["v"] for r in long.select(F.unhex(F.md5("piece")).alias("h"), F.col(value).alias("v")).collect()}


def take_long(tail: Counter, known: dict[bytes, int]) -> list[tuple[int, int]]:
    """Take the frequent long pieces out of a document's other pieces: their times and values."""
    out = []
    for p in [p for p in tail if len(p) > HEAD_CHARS] if known else ():
        v = known.get(md5(p if isinstance(p, bytes) else p.encode()).digest())
        if v is not None:
            out.append((tail.pop(p), v))
    return out


def token_counts(docs: DataFrame, tokenizer_json: str, head_pieces: int = HEAD_PIECES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``."""
    pieces = stored(with_token_counts(piece_counts(docs, tokenizer_json), tokenizer_json), "pieces")
    head = {r["piece"]: r["k"] for r in frequent_pieces(pieces, head_pieces).select("piece", "k").collect()}
    sc = docs.sparkSession.sparkContext
    box, heads, longs = sc.broadcast(tokenizer_json), sc.broadcast(head), sc.broadcast(frequent_long(pieces, "k"))

    def split(batches):
        enc, known = encoder(box.value), heads.value
        for b in batches:
            n_bytes, n_head, tails = [], [], PieceLists()
            for text in texts_of(b):
                got = enc.pieces(text.decode())
                found = list(map(known.get, got, repeat(0)))
                tail = Counter(compress(got, map(not_, found)))
                n_bytes.append(len(text))
                n_head.append(sum(found) + sum(m * k for m, k in take_long(tail, longs.value)))
                tails.add(tail)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_bytes, pa.int64()), pa.array(n_head, pa.int64()),
                 tails.array(pa.string())], ["_row", "doc_id", "n_bytes", "n_head", "tail"])

    rows = with_row(docs.select("doc_id", "text")).select("_row", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = stored(arrow_map(rows, split, f"_row bigint, doc_id {kind}, n_bytes bigint, n_head bigint, "
                                          "tail array<struct<piece:string,m:int>>"), "piece-parts")
    tail = parts.select("_row", F.explode("tail").alias("t")).select("_row", "t.piece", "t.m")
    sums = (tail.join(pieces.select("piece", "k"), "piece")
            .groupBy("_row").agg(F.sum(F.col("m") * F.col("k")).alias("n_tail")))
    return (parts.drop("tail").join(sums, "_row", "left")
            .select("doc_id", "n_bytes",
                    (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_tokens")))

