import random

import pytest

from sardonyx.llm import decontaminate as D
from sardonyx.llm.common import alnum_words
from tests.llm.frames import DOC_SCHEMA, documents


def _brute(items, words, window):
    hit, found = set(), set()
    for item, own in items:
        m = min(window, len(own))
        wins = {tuple(own[k:k + m]) for k in range(len(own) - m + 1)} if m else set()
        for p in range(len(words) - m + 1 if m else 0):
            if tuple(words[p:p + m]) in wins:
                hit.update(range(p, p + m))
                found.add(item)
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        window, letters = rng.choice([1, 2, 3, 5]), [b"a", b"b", b"c", b"d", b"e", b"f"][:rng.choice([2, 3, 6])]
        items = [(str(i), rng.choices(letters, k=rng.randint(0, 12))) for i in range(rng.randint(0, 6))]
        words = rng.choices([*letters, b"zz"], k=rng.randint(0, 40))
        spans, found = D.Automaton([(i, w, True) for i, w in items], window).matches(words)
        assert ({x for a, b in spans for x in range(a, b)}, set(found)) == _brute(items, words, window)


BENCH = [(1, "jumps over the lazy dog near the river bank tonight"), (2, "Quick brown"), (3, None), (4, "..."),
         (None, "without an id"), (5, "word1 and1, word2 and2"), (5, "tab\tand"), (6, "one")]


@pytest.mark.parametrize("block_words", [100_000, 8])
def test_find_against_brute_force(spark, block_words):
    docs = documents(spark)
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    items = [(str(i) if i is not None else "", alnum_words((t or "").encode())) for i, t in BENCH]
    want = []
    for r in docs.collect():
        words = alnum_words((r["text"] or "").encode())
        hit, found = _brute(items, words, 5)
        want.append((repr(r["doc_id"]), len(words), len(hit), sorted(found)))
    got = D.find(docs, bench, window=5, block_words=block_words).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["items"])) for r in got) == sorted(want)


def test_remove(spark):
    docs = documents(spark)
    bench = spark.createDataFrame([(1, "lazy dog near"), (2, "one")], "item_id bigint, text string")
    out = D.remove(docs, bench, window=3)
    assert out.columns == docs.columns
    rows = out.collect()
    texts = [r["text"] for r in rows if r["doc_id"] in (1, 2)]
    assert texts == ["The quick brown fox jumps over the the river bank."] * 3
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["doc_id"] in (1, 2))
    assert 9 not in {r["doc_id"] for r in rows}  # all of it was a test item
    clean = {1, 2, 9}
    assert sorted(repr(tuple(r)) for r in rows if r["doc_id"] not in clean) == \
        sorted(repr(tuple(r)) for r in docs.collect() if r["doc_id"] not in clean)


def test_empty(spark):
    none = spark.createDataFrame([], DOC_SCHEMA)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find(none, bench).count() == 0
    assert D.find(documents(spark), bench).where("n_hit > 0").count() == 0
    assert D.remove(documents(spark), bench).count() == documents(spark).count()


def test_remove_until_nothing_is_hit(spark):
    docs = spark.createDataFrame([(1, "a b c a b c d e f d e f " + "free words here and there " * 4, 9), (2, "clean", 5)],
                                 "doc_id bigint, text string, n_chars bigint")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    out = {r["doc_id"]: r for r in D.remove(docs, bench, window=6).collect()}
    assert out[1]["text"].split()[:2] == ["free", "words"] and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "clean" and out[2]["n_chars"] == 5
