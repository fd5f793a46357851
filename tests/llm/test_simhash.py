import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from sardonyx.llm import golay, simhash
from sardonyx.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.frames import DOC_SCHEMA, LONG, documents


def plain_fingerprint(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", low)
    shingles = [b" ".join(words[k:k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    """Smallest id that each document reaches over links of at most four bits."""
    root = list(range(len(ids)))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    low = defaultdict(list)
    for k, i in enumerate(ids):
        low[top(k)].append(i)
    return [min((i for i in low[top(k)] if i is not None), default=None) for k in range(len(ids))]


def test_golay_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 5000)
    for bits in range(3):
        other = words.copy()
        for _ in range(bits):
            other ^= 1 << rng.integers(0, 23, len(words))
        (a, va), (b, vb) = golay.keys(words), golay.keys(other)
        assert ((a[:, :, None] == b[:, None, :]) & va[:, :, None] & vb[:, None, :]).any((1, 2)).all()


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    keys = [defaultdict(set), defaultdict(set)]
    for side, fps in zip(keys, (a, b)):
        for key, at in zip(*(x.tolist() for x in simhash.fuzzy_keys(fps))):
            side[at].add(key)
    assert all(keys[0][k] & keys[1][k] for k in range(len(a)))


def test_fingerprints(spark):
    docs = documents(spark).collect()
    texts = [(r["text"] or "").encode() for r in docs if r["text"] != LONG]
    assert simhash.fingerprints_of(texts).tolist() == [plain_fingerprint(t.decode()) for t in texts]
    many = [t.encode() for t in ("a b c d e", "", "x")] * 3000  # more than one batch of counts
    assert simhash.fingerprints_of(many).tolist() == [plain_fingerprint(t) for t in ("a b c d e", "", "x")] * 3000


@pytest.mark.parametrize("run_limit", [2000, 2])
def test_groups_against_all_pairs(spark, run_limit):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = zip([r["doc_id"] for r in rows], [f"{p:016x}" for p in prints],
               plain_components([r["doc_id"] for r in rows], prints))
    assert sorted(map(tuple, simhash.groups(docs, run_limit=run_limit).collect())) == sorted(want)


def test_links_within_one_dense_ball(spark):
    """Many fingerprints around one centre: long runs, chains, and both ways of linking."""
    rng = np.random.default_rng(4)
    fps = np.zeros(300, np.uint64)
    for k in range(300):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            fps[k] ^= np.uint64(1) << np.uint64(bit)
    fps = np.unique(fps)
    want = plain_components(fps.view(np.int64).tolist(), fps.tolist())
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    for limit in (2000, 50, 3):
        got = {r["node"]: r["root"] for r in components(simhash.links(frame, limit)).collect()}
        assert [got.get(f, f) for f in fps.view(np.int64).tolist()] == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (7, 7), (300, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = docs.collect()
    found = simhash.groups(docs).collect()
    assert len(found) == len(rows)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    # one row per component: word-less texts (3, 4, 5, NULL) are one group
    ids = [r["doc_id"] for r in rows]
    want = plain_components(ids, [plain_fingerprint(r["text"]) for r in rows])
    assert sorted(repr(r["component_id"]) for r in found) == sorted(map(repr, want))
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, set(want)))
    assert simhash.groups(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
