"""The highest-scoring documents of each item, exactly, over geometrically blocked posting lists.

Terms are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters.  With N
documents that have a term, L terms in all, and a document of n terms, a term with weight
``w = floor(1000 ln((2N+2)/(2df+1)))`` that occurs ``tf`` times adds
``w * ((10^9 tf) div (1000 tf + 12 m))``, ``m = 75 + (25 n N) div L``: whole numbers, once per
occurrence in the item.

1. One pass over the texts counts each document's item terms; N, L and df follow.
2. Documents become vectors of impacts.  Signs of random projections order them, over ranges, so
   that like documents lie together; copies of one text are dealt on by id.
3. Any documents' scores bound an item's k-th best score from below: those of a ``SEED_SHARE`` of
   the documents do.  Terms whose greatest impacts together stay below that bound cannot bring a
   document in alone; the others are the item's lists.
4. Per chunk of documents each list that some item needs is clustered around documents of its own
   (nearest by projection) into blocks of at most ``BLOCK``; a block stores the coordinatewise
   maximum of its documents, over the terms of the items that read the list.
5. A task reads chunks one by one with a running k-th best score per item.  A block whose maxima
   cannot reach it is skipped, the documents of the others are scored in full.  Each task gives its
   k best per item and Spark ranks those.

The sample and the clusters only change how much is skipped, never what is returned.  Items are
taken in groups whose terms fit a broadcast (``ITEM_BYTES``); each group reads the documents once.

Defined results: a NULL text has no terms; equal scores go by ascending id, NULL ids last, and rows
that repeat are each ranked; every row of ``items`` is an item of its own; one without a document
above 0 has no rows; other columns are not read; ids are whole numbers; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sardonyx.llm.common import alnum_words, arrow_map, stored, texts_of, with_row

#: Documents of one block at most.
BLOCK = 64
#: Cells (documents x terms) of one chunk's matrix while it is blocked.
CELLS = 1 << 23
#: Item text (and 200 bytes for each item) of one group.
ITEM_BYTES = 1 << 17
#: Of this many documents one is scored in full for the first bounds.
SEED_SHARE = 16
ORDER_BITS, SKETCH = 16, 32
#: Stands for a NULL id, which is last.
NO_ID = (1 << 63) - 1


class Group(NamedTuple):
    """A group of items: their terms, and per item the numbers and repeats of its terms."""

    rows: list[int]
    terms: dict[bytes, int]
    parts: list[tuple[np.ndarray, np.ndarray]]


def groups_of(items: DataFrame) -> Iterator[Group]:
    """The items that have terms, in groups that fit a broadcast."""
    size = items.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 200)).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    for k in range(n):
        rows, terms, parts = [], {}, []
        for r in items.where(F.pmod(F.xxhash64("_row"), F.lit(n)) == k).select("_row", "text").collect():
            counts = Counter(alnum_words((r["text"] or "").encode()))
            if counts:
                numbers = [terms.setdefault(t, len(terms)) for t in counts]
                rows.append(r["_row"])
                parts.append((np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))
        if rows:
            yield Group(rows, terms, parts)


def _lists(column: list[np.ndarray], kind) -> pa.Array:
    ends = np.zeros(len(column) + 1, np.int32)
    np.cumsum([len(c) for c in column], out=ends[1:])
    flat = np.concatenate(column) if column else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of the rows that have a term; ``terms`` are the known ones."""
    box = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches):
        known = box.value
        for b in batches:
            ids = b.column(0).to_pylist()
            out, numbers, tfs = [], [], []
            for i, text in zip(ids, texts_of(b)):
                words = alnum_words(text)
                if words:
                    found = Counter(map(known.get, words))
                    found.pop(None, None)
                    out.append((NO_ID if i is None else i, len(words)))
                    numbers.append(np.fromiter(found.keys(), np.int32, len(found)))
                    tfs.append(np.fromiter(found.values(), np.int32, len(found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64()),
                 _lists(numbers, pa.int32()), _lists(tfs, pa.int32())], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow_map(rows, work, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Weights(NamedTuple):
    """What the impacts and weights need to know of all documents."""

    documents: int
    length: int
    weights: np.ndarray
    spread: np.ndarray  # projections of a weighted term
    centre: np.ndarray


def weights_of(counts: DataFrame, n_terms: int) -> Weights:
    total = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(n_terms, np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    n = total["n"]
    w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    spread = np.random.default_rng(42).standard_normal((n_terms, SKETCH)).astype(np.float32) * w[:, None].astype(np.float32)
    return Weights(n, total["l"], w, spread, (df / max(n, 1)).astype(np.float32) @ spread)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's offsets (from 0) and values."""
    col = batch.column(batch.schema.get_field_index(name))
    starts = col.offsets.to_numpy().astype(np.int64)
    return starts - starts[0], col.values.to_numpy(zero_copy_only=False)[starts[0]:starts[-1]]


def _sketch(weights: Weights, starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """A document's terms projected, less the mean of all documents."""
    out = np.empty((len(starts) - 1, SKETCH), np.float32)
    for at in range(0, len(out), 256):
        part = starts[at:at + 257]
        np.add.reduceat(weights.spread[terms[part[0]:part[-1]]], part[:-1] - part[0], axis=0, out=out[at:at + 256])
    return out - weights.centre


def impacts(counts: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, seed, terms, impacts`` with like documents together, written."""
    box = counts.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        known = box.value
        for b in batches:
            if not b.num_rows:
                continue
            starts, terms = _flat(b, "terms")
            _, tfs = _flat(b, "tfs")
            # Python's integers: n times N may pass 64 bits
            m = [75 + 25 * n * known.documents // known.length for n in b.column(1).to_pylist()]
            tf = tfs.astype(np.int64)
            found = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(np.array(m, np.int64), np.diff(starts)))
            signs = _sketch(known, starts, terms)[:, :ORDER_BITS] > 0
            key = signs @ (1 << np.arange(ORDER_BITS - 1, -1, -1))
            lists = b.column(b.schema.get_field_index("terms")).offsets
            lists = pa.array(lists.to_numpy() - lists[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(key, pa.int32()), pa.ListArray.from_arrays(lists, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(lists, pa.array(found, pa.int32()))], ["doc_id", "key", "terms", "impacts"])

    known = arrow_map(counts.where(F.size("terms") > 0), work,
                      "doc_id bigint, key int, terms array<int>, impacts array<int>")
    known = known.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").drop("key")
    return stored(known.withColumn("seed", F.pmod(F.xxhash64("doc_id"), F.lit(SEED_SHARE)) == 0), "impacts")


def _ranges(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all entries of ``rows``, and where each row's entries start among them."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return np.repeat(starts[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), ends - sizes


class Best:
    """The k best documents of every item that a task has seen."""

    def __init__(self, parts, weights: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.parts, self.k = parts, k
        self.least = np.ones(len(parts), np.int64) if floor is None else np.maximum(floor, 1)
        self.lists = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in parts]
        self.query = np.zeros(len(weights), np.int64)
        self.weights, self.scored = weights, 0

    def open(self, i: int) -> None:
        numbers, repeats = self.parts[i]
        self.query[numbers] = self.weights[numbers] * repeats

    def close(self, i: int) -> None:
        self.query[self.parts[i][0]] = 0

    def score(self, i: int, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray,
              rows: np.ndarray) -> None:
        """Score ``rows`` of a chunk in full for the open item and keep the best."""
        at, first = _ranges(starts, rows)
        scores = np.add.reduceat(self.query[terms[at]] * values[at], first)
        self.scored += len(rows)
        good = scores >= self.least[i]
        if good.any():
            old_ids, old_scores = self.lists[i]
            ids, scores = np.concatenate([old_ids, ids[rows[good]]]), np.concatenate([old_scores, scores[good]])
            order = np.lexsort((ids, -scores))[:self.k]
            self.lists[i] = ids[order], scores[order]
            if len(order) == self.k:
                self.least[i] = max(self.least[i], scores[order[-1]])

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.lists)), [len(ids) for ids, _ in self.lists])
        return pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(np.concatenate([a for a, _ in self.lists]), pa.int64()),
             pa.array(np.concatenate([s for _, s in self.lists]), pa.int64())], ["item", "doc_id", "score"])


def first_bounds(vectors: DataFrame, group: Group, weights: Weights, k: int) -> np.ndarray:
    """Per item a score that at least ``k`` documents reach (0: not known), from the seed documents."""
    box = vectors.sparkSession.sparkContext.broadcast((group.parts, weights.weights))

    def work(batches):
        best = Best(*box.value, k)
        for b in batches:
            if b.num_rows:
                starts, terms = _flat(b, "terms")
                ids, values, rows = b.column(0).to_numpy(), _flat(b, "impacts")[1].astype(np.int64), np.arange(b.num_rows)
                for i in range(len(best.parts)):
                    best.open(i)
                    best.score(i, ids, starts, terms, values, rows)
                    best.close(i)
        yield best.rows()

    found = arrow_map(vectors.where("seed").select("doc_id", "terms", "impacts"), work, BEST)
    floor = np.zeros(len(group.parts), np.int64)
    for r in ranked(found, k).where(F.col("rank") == k).collect():  # one row an item
        floor[r["item"]] = r["score"]
    return floor


BEST = "item int, doc_id bigint, score bigint"


def ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Plan(NamedTuple):
    """Which lists each item reads, and per list the terms its summaries cover."""

    lists: list[np.ndarray]
    cover: dict[int, np.ndarray]


def plan_lists(group: Group, weights: np.ndarray, most: np.ndarray, floor: np.ndarray) -> Plan:
    """The lists of item i: all but the terms whose greatest impacts together stay below ``floor[i]``."""
    lists, cover = [], {}
    for (numbers, repeats), least in zip(group.parts, floor):
        reach = most[numbers] * weights[numbers] * repeats
        order = np.argsort(reach, kind="stable")
        mine = numbers[order[np.cumsum(reach[order]) >= max(least, 1)]]
        lists.append(mine)
        for t in mine.tolist():
            cover.setdefault(t, []).append(numbers)
    return Plan(lists, {t: np.unique(np.concatenate(parts)) for t, parts in cover.items()})


def greatest(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """Per term its greatest impact in any document."""
    def work(batches):
        most = np.zeros(n_terms, np.int64)
        for b in batches:
            np.maximum.at(most, _flat(b, "terms")[1], _flat(b, "impacts")[1])
        there = most.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(most[there], pa.int64())], ["t", "most"])

    most = np.zeros(n_terms, np.int64)
    parts = arrow_map(vectors.select("terms", "impacts"), work, "t int, most bigint")
    for r in parts.groupBy("t").agg(F.max("most").alias("most")).collect():
        most[r["t"]] = r["most"]
    return most


#: One record of the index: a chunk's documents, their vectors, its blocks and their summaries, as
#: little-endian arrays (ids 64 bits, all else 32).
FIELDS = ("ids", "starts", "terms", "impacts", "block_list", "block_starts", "block_docs",
          "summary_starts", "summary_terms", "summary_most")
INDEX = ", ".join(f"{f} binary" for f in FIELDS)


class Chunk(NamedTuple):
    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    block_list: np.ndarray
    block_starts: np.ndarray
    block_docs: np.ndarray
    summary_starts: np.ndarray
    summary_terms: np.ndarray
    summary_most: np.ndarray

    def record(self) -> dict:
        return {f: np.asarray(v, "<i8" if f == "ids" else "<i4").tobytes() for f, v in zip(FIELDS, self)}

    @staticmethod
    def read(record: dict) -> Chunk:
        return Chunk(*[np.frombuffer(record[f], "<i8" if f == "ids" else "<i4").astype(np.int64) for f in FIELDS])


def clusters(docs: np.ndarray, sketches: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A list's documents by nearest of ``len / block`` of them, and where blocks of at most ``block`` start."""
    if len(docs) <= block:
        return docs, np.zeros(1, np.int64)
    heads = sketches[docs[::block]]
    nearest = np.argmax(sketches[docs] @ heads.T, axis=1)
    sizes = np.bincount(nearest, minlength=len(heads))
    first = np.cumsum(sizes) - sizes
    starts = [np.arange(a, a + n, block) for a, n in zip(first, sizes) if n]
    return docs[np.argsort(nearest, kind="stable")], np.concatenate(starts)


def block_chunk(ids, starts, terms, values, plan: Plan, weights: Weights, block: int) -> Chunk:
    """The blocks of every list that the plan names, over one chunk of documents."""
    n = len(starts) - 1
    doc_of = np.repeat(np.arange(n), np.diff(starts))
    matrix = np.zeros((n, len(weights.weights)), np.int32)
    matrix[doc_of, terms] = values
    sketches = _sketch(weights, starts, terms)
    sketches /= np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-9)
    order = np.argsort(terms, kind="stable")
    there, first = np.unique(terms[order], return_index=True)
    ends = np.append(first[1:], len(order))
    lists, block_docs, block_at, sums = [], [], [0], []
    for t, a, z in zip(there.tolist(), first, ends):
        cover = plan.cover.get(t)
        if cover is None:
            continue
        docs, cuts = clusters(doc_of[order[a:z]], sketches, block)
        sums.append((np.maximum.reduceat(matrix[np.ix_(docs, cover)], cuts, axis=0), cover))
        lists += [t] * len(cuts)
        block_at += (block_at[-1] + np.append(cuts[1:], len(docs))).tolist()
        block_docs.append(docs)
    entries = [(s.nonzero(), s, cover) for s, cover in sums]
    sizes = np.concatenate([np.bincount(nz[0], minlength=len(s)) for nz, s, _ in entries]) if entries else np.empty(0, int)
    empty = np.empty(0, np.int64)

    def flat(parts):
        return np.concatenate(parts) if parts else empty

    return Chunk(ids, starts, terms, values, np.array(lists, np.int64), np.array(block_at), flat(block_docs),
                 np.append(0, np.cumsum(sizes)), flat([cover[nz[1]] for nz, _, cover in entries]),
                 flat([s[nz] for nz, s, _ in entries]))


def build_index(vectors: DataFrame, plan: Plan, weights: Weights, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """The blocked lists, one record per chunk of neighbouring documents, written."""
    box = vectors.sparkSession.sparkContext.broadcast((plan, weights))
    size = max(16, cells // max(1, len(weights.weights)))

    def work(batches):
        lists, known = box.value
        schema = pa.schema([(f, pa.binary()) for f in FIELDS])

        def chunk(parts):
            ids = np.concatenate([p[0] for p in parts])
            starts = np.append(0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts])))
            terms, values = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
            made = block_chunk(ids, starts, terms, values, lists, known, block)
            return pa.RecordBatch.from_pylist([made.record()], schema)

        held, n = [], 0
        for b in batches:
            ids, (starts, terms), (_, values) = b.column(0).to_numpy(), _flat(b, "terms"), _flat(b, "impacts")
            at = 0
            while at < len(ids):
                z = min(len(ids), at + size - n)
                held.append((ids[at:z], starts[at:z + 1], terms[starts[at]:starts[z]], values[starts[at]:starts[z]]))
                n, at = n + z - at, z
                if n == size:
                    yield chunk(held)
                    held, n = [], 0
        if held:
            yield chunk(held)

    return stored(arrow_map(vectors.select("doc_id", "terms", "impacts"), work, INDEX), "blocked-lists")


def search_chunk(chunk: Chunk, plan: Plan, best: Best) -> int:
    """Score what a chunk's blocks can still bring into the lists; the number of blocks skipped."""
    skipped = 0
    for i, lists in enumerate(plan.lists):
        a, z = np.searchsorted(chunk.block_list, np.sort(lists)), np.searchsorted(chunk.block_list, np.sort(lists), "right")
        blocks = np.concatenate([np.arange(x, y) for x, y in zip(a, z)]) if len(lists) else a
        if not len(blocks):
            continue
        best.open(i)
        at, first = _ranges(chunk.summary_starts, blocks)
        bound = np.add.reduceat(best.query[chunk.summary_terms[at]] * chunk.summary_most[at], first)
        reach = blocks[bound >= best.least[i]]
        skipped += len(blocks) - len(reach)
        if len(reach):
            places, _ = _ranges(chunk.block_starts, reach)
            best.score(i, chunk.ids, chunk.starts, chunk.terms, chunk.impacts, np.unique(chunk.block_docs[places]))
        best.close(i)
    return skipped


def search_index(index: DataFrame, group: Group, weights: Weights, plan: Plan, floor: np.ndarray, k: int) -> DataFrame:
    """``item, doc_id, score, rank``: the k best of every item of the group."""
    box = index.sparkSession.sparkContext.broadcast((group.parts, weights.weights, plan, floor))

    def work(batches):
        parts, w, lists, least = box.value
        best = Best(parts, w, k, least)
        for b in batches:
            for r in range(b.num_rows):
                search_chunk(Chunk.read(b.slice(r, 1).to_pylist()[0]), lists, best)
        yield best.rows()

    return ranked(arrow_map(index, work, BEST), k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    items = stored(with_row(items.select("item_id", "text")), "items")
    kind = docs.schema["doc_id"].dataType
    out = None
    for group in groups_of(items):
        counts = stored(term_counts(docs, group.terms), "term-counts")
        weights = weights_of(counts, len(group.terms))
        vectors = impacts(counts, weights)
        floor = first_bounds(vectors, group, weights, k)
        plan = plan_lists(group, weights.weights, greatest(vectors, len(group.terms)), floor)
        index = build_index(vectors, plan, weights, block, cells)
        found = search_index(index, group, weights, plan, floor, k)
        names = spark.createDataFrame(list(enumerate(group.rows)), "item int, _row bigint")
        found = stored(found.join(F.broadcast(names), "item"), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item int, doc_id bigint, score bigint, rank int, _row bigint")
    return out.join(items.drop("text"), "_row").select(
        "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).cast(kind).alias("doc_id"), "score")
