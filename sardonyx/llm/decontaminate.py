"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words become one suffix automaton (a state per class of word
sequences with the same ends, at most two states a word).  Every document's
words are streamed through it; at each word the automaton holds the longest
item substring that ends there.  Where that length reaches ``window`` words,
the words it spans are hit; an item of fewer words is hit as a whole.  Spans
are then removed, and documents whose hit share exceeds a limit go.

A pair filter stands before the automaton: a document word can only be part
of a match of two words or more if the pair with a neighbour occurs in an
item, so runs of words without such pairs are passed over in numpy.

Size of the benchmark: its words are counted by Spark first.  One automaton
holds at most about ``BLOCK_WORDS`` words (some 20 MB) and is broadcast; a
larger benchmark is cut into blocks by hash (long items into overlapping
pieces first), the documents are streamed once per block, and the spans of
the blocks are merged per document.

Defined results: NULL texts and items have no words; items without words are
ignored; a NULL item id counts as the empty string and rows that repeat an
item id count as one item; repeated documents give a row each; an empty
benchmark hits nothing.  Extra columns pass through ``remove`` untouched.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sardonyx.llm.common import LOWER_ALNUM, alnum_words, arrow_map, fresh, stored, texts_of, with_row

WINDOW = 10
#: Words in one automaton.
BLOCK_WORDS = 100_000
#: Documents with a larger share of hit words are dropped, not mended.
COVERAGE = 0.5


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes], bool]], window: int):
        """``items``: id, words, and whether these words are a whole item."""
        self.window, self.vocab = window, {}
        nxt: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        self.nxt, self.link, self.size = nxt, link, size
        self.item_ids = sorted({i for i, _, _ in items})
        number = {x: k for k, x in enumerate(self.item_ids)}
        texts = [(number[i], [self.vocab.setdefault(w, len(self.vocab)) for w in words], whole)
                 for i, words, whole in items if words]
        for _, words, _ in texts:
            last = 0
            for c in words:
                last = self._extend(last, c)
        shorts: dict[int, list[tuple[int, int]]] = {}
        owners: dict[int, set[int]] = {}
        for item, words, whole in texts:
            s = 0
            for c in words:
                s = nxt[s][c]
                t = s
                # the states of all window-long or longer suffixes that end here
                while t > 0 and size[t] >= window and item not in owners.setdefault(t, set()):
                    owners[t].add(item)
                    t = link[t]
            if whole and len(words) < window:
                while size[link[s]] >= len(words):  # the state of the whole item
                    s = link[s]
                shorts.setdefault(s, []).append((len(words), item))
        self.shorts, self.owners = shorts, owners
        self.least = min([window] + [n for v in shorts.values() for n, _ in v])
        pairs = {a * len(self.vocab) + b for _, w, _ in texts for a, b in zip(w, w[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        bits = 1 << max(16, (8 * len(pairs)).bit_length())
        self.pair_bits = np.zeros(bits, bool)
        self.pair_bits[self._hash(self.pairs)] = True

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed >> np.uint64(65 - len(self.pair_bits).bit_length())

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.nxt, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self.nxt, self.link, self.size
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Hit word spans (half open, disjoint, ascending) and the ids of the occurring items."""
        n = len(words)
        if n < self.least or not self.vocab:
            return [], []
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if self.least == 1:
            runs = [(0, n)]
        else:
            a, b = ids[:-1], ids[1:]
            maybe = (a >= 0) & (b >= 0)
            maybe &= self.pair_bits[self._hash(np.where(maybe, a * len(self.vocab) + b, 0))]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], maybe, [False]]).astype(np.int8)))
            begin, end = edge[::2], edge[1::2] + 1
            long = end - begin >= self.least
            runs = list(zip(begin[long].tolist(), end[long].tolist()))
        for lo, hi in runs:
            self._stream(ids[lo:hi].tolist(), lo, spans, found)
        return _merged(spans), [self.item_ids[k] for k in found]

    def _stream(self, ids: list[int], at: int, spans: list, found: set) -> None:
        nxt, link, size, window, shorts = self.nxt, self.link, self.size, self.window, self.shorts
        s = n = 0
        for i, c in enumerate(ids, at + 1):
            while s and c not in nxt[s]:
                s = link[s]
                n = size[s]
            s = nxt[s].get(c, 0)
            n = n + 1 if s else 0
            if n >= window:
                spans.append((i - n, i))
                t = s
                while size[link[t]] >= window:
                    t = link[t]
                found |= self.owners[t]
            if shorts and n >= self.least:
                t = s
                while t > 0:
                    for m, item in shorts.get(t, ()):
                        if m <= n:
                            spans.append((i - m, i))
                            found.add(item)
                    t = link[t]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """``item, words, whole``: the items' words, long items in overlapping pieces."""
    def cut(batches):
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), texts_of(b)):
                words = alnum_words(text)
                step = max(block_words - window + 1, 1)
                for k in range(0, max(len(words) - window + 1, 1) if words else 0, step):
                    rows.append((item or "", words[k:k + step + window - 1], len(words) < window))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary())),
                 pa.array([r[2] for r in rows], pa.bool_())], ["item", "words", "whole"])

    src = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return stored(arrow_map(src, cut, "item string, words array<binary>, whole boolean"), "items")


_FOUND = "n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"


def _streamed(rows: DataFrame, automaton: Automaton) -> DataFrame:
    """``_row, doc_id`` and what one automaton finds in each document."""
    box = rows.sparkSession.sparkContext.broadcast(automaton)
    kinds = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        auto = box.value
        for b in batches:
            counts, spans, items = [], [], []
            for text in texts_of(b):
                words = alnum_words(text)
                s, i = auto.matches(words)
                counts.append(len(words))
                spans.append([{"a": x, "b": y} for x, y in s])
                items.append(i)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(spans, kinds),
                 pa.array(items, pa.list_(pa.string()))], ["_row", "doc_id", "n_words", "spans", "items"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows.select("_row", "doc_id", "text"), run, f"_row bigint, doc_id {kind}, {_FOUND}")


def find_rows(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW,
              block_words: int = BLOCK_WORDS) -> DataFrame:
    """``_row, doc_id, n_words, spans, items`` for rows that carry a stored ``_row``.

    With more than one block, spans of different blocks may overlap; see ``hit_words``.
    """
    pieces = _pieces(benchmark, window, block_words)
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block_words))
    if blocks > 1:  # the handles must be the same in every pass
        rows = stored(rows, "decontaminate-rows")
    found = None
    for k in range(blocks):
        mine = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        items = [(r["item"], [bytes(w) for w in r["words"]], r["whole"]) for r in mine.toLocalIterator()]
        part = _streamed(rows, Automaton(items, window))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:  # at most one row per block and document
        found = found.groupBy("_row", "doc_id").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return found


def hit_words(spans: str = "spans"):
    """The number of words that ascending, perhaps overlapping spans cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, zero, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["end"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(acc["end"], x["b"]).alias("end")))["n"]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every document."""
    found = find_rows(with_row(docs.select("doc_id", "text")), benchmark, window, block_words)
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), "spans", "items")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word spans, the white space beside them made one space."""
    flat = text.translate(LOWER_ALNUM)  # byte positions stay
    at, where, pos = [], flat.split(), 0
    for w in where:
        a = flat.index(w, pos)
        pos = a + len(w)
        at.append((a, pos))
    out, done = [], 0
    for a, b in spans:
        out.append(text[done:at[a][0]])
        done = at[b - 1][1]
    out.append(text[done:])
    kept = [p.strip() if k else p.rstrip() for k, p in enumerate(out[:-1])] + [out[-1].lstrip()]
    return b" ".join(p for p in kept if p)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without hit spans; documents hit in more than ``coverage`` of their words go.

    Cutting goes on until no text holds a window (a cut may join the halves of one).

    Clean rows keep their text byte for byte.  ``n_chars``, where the table
    has it, follows the new text.
    """
    handle, new, mark = (fresh(docs, n) for n in ("_row", "_new", "_hit"))
    rows = stored(with_row(docs, handle), "decontaminate-input")
    narrow = rows.select(F.col(handle).alias("_row"), "doc_id", "text")

    def mend(batches):
        for b in batches:
            texts = []
            for text, spans in zip(texts_of(b), b.column(2).to_pylist()):
                pairs = _merged([(s["a"], s["b"]) for s in spans])
                texts.append(cut_spans(text, pairs).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             ["_row", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    changed, current = None, narrow
    while True:  # what a cut joins may be a passage again: cut until nothing is hit
        hit = stored(find_rows(current, benchmark, window, block_words).where(F.size("spans") > 0), "hits")
        if hit.isEmpty():
            break
        light = hit.where(hit_words() <= F.col("n_words") * coverage).select("_row", "spans")
        current = stored(arrow_map(current.join(light, "_row").select("_row", "doc_id", "spans", "text"), mend,
                                   f"_row bigint, doc_id {kind}, text string"), "mended")
        now = hit.select("_row").join(current.select("_row", F.col("text").alias("_text")), "_row", "left")
        changed = now if changed is None else now.unionByName(changed.join(hit, "_row", "left_anti"))
    if changed is None:
        return rows.select(docs.columns)
    changed = changed.select(F.col("_row").alias(handle), F.col("_text").alias(new), F.lit(True).alias(mark))
    out = rows.join(changed, handle, "left").where(F.col(mark).isNull() | F.col(new).isNotNull())
    fixed = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        n = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new))
        fixed["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return out.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in docs.columns])
