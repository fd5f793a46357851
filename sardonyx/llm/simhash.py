"""SimHash near-dedup by Golay-code fuzzy keys.

Fingerprint: the majority of the 64 bits over the XXH64 of a text's word
shingles.  Two fingerprints link at ``DISTANCE`` (four) or fewer differing
bits.  The 64 bits are cut into three segments of 22, 21 and 21 bits, each
decoded to the indices of its nearby Golay codewords (see ``golay``: words up
to two bits apart share an index).  With at most four errors in all, either

* one segment has none, and then another has two at most: key = that segment
  as it is and an index of the other (34 bits), for the six ordered choices; or
* every segment has one or two: key = an index of each of the three (36 bits).

So every linked pair shares a key.  Keys are dealt by hash and sorted; each
run of one key is searched as it streams past, and candidates are verified by
their bit distance.  A run gives at most a spanning forest of its links, never
all pairs.  Runs above ``RUN_LIMIT`` distinct fingerprints are not compared
pairwise: their members go by midpoints instead (two fingerprints at most four
bits apart have a word at most two bits from both, and all fingerprints that
meet in such a word are linked), which is linear in the group and as exact.

Equal fingerprints are one node, so groups of copies cost one row.  Components
of the link table give each document the smallest id that it reaches.

Defined results: NULL and word-less texts have fingerprint zero and link like
any other; a text of fewer words than a shingle is one shingle; NULL ids never
are the smallest (a component of NULL ids only has a NULL id); of rows that
repeat an id, ``dedup`` keeps one; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sardonyx.llm import golay
from sardonyx.llm.common import arrow_map, keep_rows, space_words, stored, texts_of, with_row
from sardonyx.llm.components import components

WORDS = 4
DISTANCE = 4
SEED = 42
RUN_LIMIT = 2000
#: Share of all rows above which a fingerprint's copies meet their group on the map side.
HEAVY = 0.001
#: Shingles hashed between two bit counts, and fingerprints keyed at a time.
CHUNK = 1 << 19
KEY_CHUNK = 4096
_LANES = np.uint64(0x0101010101010101)
#: Segments: shift and width.
_SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``(groups, 64)`` counts of set bits over groups of hashes; ``starts`` ascending, none empty."""
    ends = np.append(starts[1:], len(hashes))
    sizes = -(-(ends - starts) // 255)  # byte lanes hold sums up to 255
    first = np.cumsum(sizes) - sizes
    cuts = np.repeat(starts, sizes) + 255 * (np.arange(sizes.sum()) - np.repeat(first, sizes))
    out = np.empty((len(starts), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        out[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return out


def shingle_hashes(words: list[bytes], k: int = WORDS):
    """XXH64 of every shingle, in pieces of at most CHUNK."""
    if not words:
        return
    if len(words) < k:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    for at in range(0, len(words) - k + 1, CHUNK):
        part = words[at:at + CHUNK + k - 1]
        joined = map(b" ".join, zip(*(islice(part, j, None) for j in range(k))))
        yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(part) - k + 1)


def fingerprints_of(texts, k: int = WORDS) -> np.ndarray:
    """Fingerprints of an iterable of UTF-8 texts."""
    counts, totals = [], []  # per text
    hashes, owners, held = [], [], 0

    def count() -> None:
        nonlocal hashes, owners, held
        if hashes:
            starts = np.cumsum([0] + [len(h) for h in hashes[:-1]])
            for o, c in zip(owners, _bit_counts(np.concatenate(hashes), starts)):
                counts[o] = c if counts[o] is None else counts[o] + c
        hashes, owners, held = [], [], 0

    done: list[np.ndarray] = []

    def settle() -> None:
        count()
        if totals:
            c = np.array([np.zeros(64, np.int64) if x is None else x for x in counts])
            bits = (2 * c > np.array(totals)[:, None]).astype(np.uint8)
            done.append(np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel())
        counts.clear()
        totals.clear()

    for text in texts:
        if held >= CHUNK or len(totals) >= 8192:
            settle()
        counts.append(None)
        totals.append(0)
        for h in shingle_hashes(space_words(text), k):
            hashes.append(h)
            owners.append(len(totals) - 1)
            totals[-1] += len(h)
            held += len(h)
            if held >= CHUNK and len(h) == CHUNK:
                count()
    settle()
    return np.concatenate(done) if done else np.empty(0, np.uint64)


def fingerprints(rows: DataFrame, k: int = WORDS) -> DataFrame:
    """``_row, doc_id, fp`` (the 64 bits as a bigint) of rows that carry ``_row``."""
    def run(batches):
        for b in batches:
            fp = fingerprints_of(texts_of(b), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["_row", "doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows.select("_row", "doc_id", "text"), run, f"_row bigint, doc_id {kind}, fp bigint")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, position)`` of all keys of some fingerprints."""
    whole = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in _SEGMENTS]
    near = [golay.keys(w) for w in whole]
    out, pos = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                r, c = np.nonzero(near[j][1])
                out.append((whole[i][r] << 12 | near[j][0][r, c]) | (3 * i + j) << 40)
                pos.append(r)
    valid = near[0][1][:, :, None, None] & near[1][1][:, None, :, None] & near[2][1][:, None, None, :]
    r, a, b, c = np.nonzero(valid)
    out.append(near[0][0][r, a] << 24 | near[1][0][r, b] << 12 | near[2][0][r, c] | 9 << 40)
    pos.append(r)
    return np.concatenate(out), np.concatenate(pos)


def midpoints(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(word, position)``: all words at most two bits from each fingerprint."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
    return (fps[:, None] ^ masks).ravel().view(np.int64), np.repeat(np.arange(len(fps)), len(masks))


def _keyed(fps: DataFrame, keys, chunk: int) -> DataFrame:
    """``key, fp`` rows, dealt by key and sorted."""
    def run(batches):
        for b in batches:
            all_fps = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_fps), chunk):
                part = all_fps[at:at + chunk]
                k, pos = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[pos].view(np.int64))], ["key", "fp"])

    return arrow_map(fps.select("fp"), run, "key bigint, fp bigint").repartition("key") \
        .sortWithinPartitions("key", "fp")


def run_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links within one run."""
    links, rest = [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            f = front.pop()
            near = np.bitwise_count(rest ^ f) <= distance
            if near.any():
                found = rest[near]
                links += [(f, x) for x in found]
                front += list(found)
                rest = rest[~near]
    return links


def _linked(keyed: DataFrame, run_limit: int, distance: int) -> DataFrame:
    """``a, b`` links found in sorted runs; rows with NULL ``b`` are members of runs above the limit."""
    def search(keys: np.ndarray, fps: np.ndarray):
        """All runs of a stretch of whole runs within the limit."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        a, b = [], []
        small = np.repeat(sizes <= 8, sizes)
        for o in range(1, 8):
            at = np.flatnonzero((keys[o:] == keys[:-o]) & small[o:]) if len(keys) > o else np.empty(0, int)
            if not len(at):
                break
            near = at[np.bitwise_count(fps[at] ^ fps[at + o]) <= distance]
            a.append(fps[near])
            b.append(fps[near + o])
        for k in np.flatnonzero(sizes > 8):
            for x, y in run_links(fps[starts[k]:starts[k] + sizes[k]], distance):
                a.append(np.array([x]))
                b.append(np.array([y]))
        if not a:
            return None
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1).view(np.int64), axis=0)
        return _pairs(pairs[:, 0], pairs[:, 1])

    def _pairs(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        hot = None  # the key of a run that is too long
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if hot is not None:
                n = int(np.searchsorted(k, hot, "right"))
                if n:
                    yield _pairs(f[:n].view(np.int64), [None] * n)
                    k, f = k[n:], f[n:]
                if not len(k):
                    continue
                hot = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            done = np.ones(len(keys), bool)
            done[starts[-1]:] = False  # the last run may go on
            for s in np.flatnonzero(sizes > run_limit):
                lo, hi = starts[s], starts[s] + sizes[s]
                yield _pairs(fps[lo:hi].view(np.int64), [None] * int(hi - lo))
                done[lo:hi] = False
                if s == len(sizes) - 1:
                    hot = keys[-1]
            if done.any() and (out := search(keys[done], fps[done])) is not None:
                yield out
            keep = slice(len(keys) if hot is not None else starts[-1], None)
            keys, fps = keys[keep].copy(), fps[keep].copy()
        if len(keys) and (out := search(keys, fps)) is not None:
            yield out

    return arrow_map(keyed, run, "a bigint, b bigint")


def _met(keyed: DataFrame) -> DataFrame:
    """``a, b``: the first fingerprint at each midpoint and every other there."""
    def run(batches):
        last = first = None
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[last is None or k[0] != last], k[1:] != k[:-1]])
            lead = np.where(new, f, 0)
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            lead = np.where(at >= 0, f[np.maximum(at, 0)], first if first is not None else 0)
            last, first = k[-1], lead[-1]
            apart = lead != f
            if apart.any():
                pairs = np.unique(np.stack([lead[apart], f[apart]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return arrow_map(keyed, run, "a bigint, b bigint")


def links(fps: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``a, b`` links that connect all of the distinct ``fp`` within four bits of each other."""
    found = stored(_linked(_keyed(fps, fuzzy_keys, KEY_CHUNK), run_limit, DISTANCE).distinct(), "links")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    return found.where("b is not null").unionByName(_met(_keyed(hot, midpoints, 64)).distinct())


def near_groups(rows: DataFrame, k: int = WORDS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``_row, doc_id, fp, component_id, kept`` for rows that carry a stored ``_row``."""
    prints = stored(fingerprints(rows, k), "fingerprints")
    # of a fingerprint's rows the smallest id, NULL last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    nodes = stored(prints.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    roots = stored(components(links(nodes, run_limit)), "components")
    heads = (nodes.join(roots, nodes["fp"] == roots["node"]).groupBy("root").agg(F.min("first").alias("head")))
    grouped = roots.join(heads, "root").select(F.col("node").alias("fp"), "head")
    named = stored(nodes.join(grouped, "fp", "left").select("fp", "n", F.coalesce("head", "first").alias("head")),
                   "fingerprint-heads")
    # a fingerprint of many copies would be a hot join key; at most 1/HEAVY of them are broadcast instead
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.broadcast(named.where(F.col("n") > total * HEAVY).select("fp", "head"))
    light = prints.join(heavy.select("fp"), "fp", "left_anti").join(named.select("fp", "head"), "fp")
    return prints.join(heavy, "fp").unionByName(light).select(
        "_row", "doc_id", "fp", F.col("head.doc_id").alias("component_id"),
        (F.col("_row") == F.col("head._row")).alias("kept"))


def groups(docs: DataFrame, k: int = WORDS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    found = near_groups(with_row(docs.select("doc_id", "text")), k, run_limit)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, k: int = WORDS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id."""
    return keep_rows(docs, lambda rows: near_groups(rows, k, run_limit), "simhash-input")
