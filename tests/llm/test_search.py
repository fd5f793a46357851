"""Ranked search against scores of all documents in plain Python, with small blocks, and awkward rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sardonyx.llm import lexical_search as search
from tests.conftest import SF_SMALL
from tests.llm import frames

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEM_SCHEMA = "item_id string, text string, doc_id bigint, score int, item int"


def words(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k):
    """``(item, rank, doc, score)`` of all items, every document scored."""
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(words(text)), []
        for i, c in held:
            m = 75 + 25 * c.total() * n_docs // length
            scores.append((sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                               * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c), i))
        best = sorted((-s, i is None, i or 0) for s, i in scores if s > 0)[:k]
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(best, 1)]
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def rows_of(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=key)


def random_tables(seed, n_docs=500, n_items=25):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["Ünï", "中文", "a", "B2"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    topics = [rng.sample(vocab, 12) for _ in range(10)]
    docs = []
    for i in range(n_docs):
        own = rng.choice(topics)
        docs.append((i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 40)) + rng.choices(own, k=rng.randint(0, 20)))))
    docs += [(i, docs[7][1]) for i in range(n_docs, n_docs + 60)] + [(3, docs[3][1]), (None, docs[7][1]), (None, None)]
    items = [(f"i{k}", " ".join(rng.choices(vocab, k=rng.randint(1, 12)) + rng.choices(rng.choice(topics), k=5)).upper())
             for k in range(n_items)]
    return docs, items + [("i0", "w1 w1 w2"), (None, "w3"), ("none", "zzz"), ("empty", ""), ("null", None), ("copies", docs[7][1])]


def frame(spark, docs, items, parts=4):
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs],
                              "doc_id bigint, text string, score string, item string, n int")
    return d.repartition(parts), spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], ITEM_SCHEMA)


@pytest.mark.parametrize("parts, block, cells", [(1, 4, 1 << 14), (6, 1, 1 << 13), (3, 64, 1 << 23)])
def test_against_all_documents(spark, parts, block, cells):
    docs, items = random_tables(parts)
    d, b = frame(spark, docs, items, parts)
    assert rows_of(search.search(d, b, 20, block, cells)) == sorted(plain(docs, items, 20), key=key)


def test_items_in_several_groups(spark, monkeypatch):
    docs, items = random_tables(9, 200, 12)
    monkeypatch.setattr(search, "ITEM_BYTES", 600)
    d, b = frame(spark, docs, items)
    assert rows_of(search.search(d, b, 7, 8)) == sorted(plain(docs, items, 7), key=key)


def test_blocks_are_skipped_by_exact_bounds():
    """Every document of a block scores at most the block's bound, and most blocks are skipped."""
    rng = np.random.default_rng(1)
    n_terms, n_docs = 60, 400
    lists = [np.sort(rng.choice(n_terms, rng.integers(1, 15), replace=False)) for _ in range(n_docs)]
    starts, terms = np.append(0, np.cumsum([len(x) for x in lists])), np.concatenate(lists)
    values = rng.integers(1, 1000, len(terms))
    w = rng.integers(1, 9000, n_terms)
    spread = rng.standard_normal((n_terms, search.SKETCH)).astype(np.float32)
    weights = search.Weights(n_docs, 1, w, spread, spread.mean(axis=0))
    parts = [(rng.choice(n_terms, 8, replace=False), rng.integers(1, 3, 8)) for _ in range(12)]
    most = np.zeros(n_terms, np.int64)
    np.maximum.at(most, terms, values)
    group = search.Group(list(range(12)), {}, parts)
    plan = search.plan_lists(group, w, most, np.zeros(12, np.int64))
    chunk = search.block_chunk(np.arange(n_docs), starts, terms, values, plan, weights, 5)
    again = search.Chunk.read(chunk.record())
    assert all((np.asarray(a) == b).all() for a, b in zip(chunk, again))
    for b, t in enumerate(chunk.block_list):
        docs = chunk.block_docs[chunk.block_starts[b]:chunk.block_starts[b + 1]]
        assert 1 <= len(docs) <= 5 and all(t in lists[d] for d in docs)
        at = slice(chunk.summary_starts[b], chunk.summary_starts[b + 1])
        stored = dict(zip(chunk.summary_terms[at], chunk.summary_most[at]))
        for c in plan.cover[t]:
            assert stored.get(c, 0) == max([values[starts[d] + list(lists[d]).index(c)] for d in docs if c in lists[d]],
                                           default=0)
    first = search.Best(parts, w, 5)
    search.search_chunk(chunk, plan, first)
    second = search.Best(parts, w, 5, first.least)
    skipped = search.search_chunk(chunk, plan, second)
    read = sum(np.isin(chunk.block_list, mine).sum() for mine in plan.lists)
    assert skipped > read / 2 and second.scored < first.scored
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(first.lists, second.lists))


def test_awkward_tables(spark):
    docs = frames.documents(spark)
    items = spark.createDataFrame([("a", "quick THE text id", 1, 2, 3), ("b", frames.LONG, 1, 2, 3)], ITEM_SCHEMA)
    want = plain([(r[0], r[1]) for r in frames.ROWS], [("a", "quick THE text id"), ("b", frames.LONG)], 20)
    assert rows_of(search.search(docs, items)) == sorted(want, key=key)
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_small_table(spark):
    read = "SELECT {}, text FROM read_parquet('" + SF_SMALL + "/{}.parquet')"
    docs, items = (duckdb.sql(read.format(c, t)).fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    found = search.search(spark.read.parquet(f"{SF_SMALL}/documents.parquet"),
                          spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"), block=8, cells=1 << 16)
    assert rows_of(found) == sorted(plain(docs, items, 20), key=key)
