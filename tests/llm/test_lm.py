import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sardonyx.llm import lm_scores
from sardonyx.llm.common import crc_mod, space_words
from sardonyx.llm.lbl import CONTEXT, LogBilinear
from tests.conftest import SF_CHECK
from tests.llm.frames import DOC_SCHEMA, documents


def _plain(rows):
    """Tokens, known tokens, training tokens and base score of each row."""
    texts = [(i, [*space_words((t or "").encode()), b""]) for i, t in rows]
    counts = Counter()
    for i, words in texts:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    return [(repr(i), len(w), sum(counts[x] > 0 for x in w), n,
             sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in texts]


def _check(docs, head):
    got = lm_scores.scores(docs, crc_mod("doc_id", 7) != 2, head=head).collect()
    rows = sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    want = sorted(_plain([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert [r[:4] for r in rows] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in rows], [r[4] for r in want], rtol=1e-9)
    assert all(r["score"] < 0 for r in got)
    return got


@pytest.mark.parametrize("head", [131_072, 20])
def test_awkward_rows(spark, head):
    _check(documents(spark), head)


def test_beats_the_base_on_held_out_texts(spark):
    got = _check(spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text"), lm_scores.HEAD_WORDS)
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    counts = np.arange(200, 0, -1).astype(float)
    model = LogBilinear(300, counts, 50.0)
    rng = np.random.default_rng(1)
    train = model.trainer(1)
    for _ in range(20):
        train.step(rng.integers(0, 300, (64, CONTEXT)), rng.integers(0, 201, 64))
    model.params = train.params
    x = np.repeat(rng.integers(0, 300, (5, CONTEXT)), 201, axis=0)
    p = np.exp(model.log_probs(x, np.tile(np.arange(201), 5))).reshape(5, 201)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_training_learns_pairs():
    counts = np.full(100, 100.0)
    model, rng = LogBilinear(101, counts, 0.0), np.random.default_rng(2)
    x = rng.integers(0, 100, (4096, CONTEXT))
    y = (x[:, 0] // 64) * 64 + x[:, 0] % 8  # fixed by the previous word
    before, train = model.log_probs(x, y).mean(), model.trainer(3)
    for k in range(150):
        at = rng.integers(0, 4096, 512)
        train.step(x[at], y[at])
    model.params = train.params
    assert model.log_probs(x, y).mean() > before + 1


def test_empty(spark):
    none = spark.createDataFrame([], DOC_SCHEMA)
    assert lm_scores.scores(none, crc_mod("doc_id", 7) != 2).count() == 0
    one = documents(spark).where("doc_id = 9")
    got = lm_scores.scores(one, crc_mod("doc_id", 7) > 100).collect()  # nothing to learn from
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(2, 0, 0, 0.0)]


def test_classes_are_stepped_in_blocks():
    """One step over neighbouring classes at once: the gradients of every class by itself, in few blocks."""
    from sardonyx.llm.lbl import CLASS_WORDS, LogBilinear, _blocks
    rng = np.random.default_rng(5)
    counts = np.sort(rng.integers(1, 500, 20 * CLASS_WORDS - 11))[::-1]
    model = LogBilinear(300, counts.astype(float), 900.0)
    y = np.minimum((len(counts) + 200) * rng.random(3000) ** 1.5, len(counts)).astype(np.int64)
    q = rng.standard_normal((3000, 24)).astype(np.float32)
    _, order, groups = model._levels(y)
    q, y = q[order], y[order]
    blocks = _blocks(groups)
    assert [g for b in blocks for g in b] == groups and len(groups) >= 20 and len(blocks) <= 8
    one, all_ = model.trainer(3), model.trainer(3)
    for b in blocks:
        dq, dr, db = all_._nce_block(q, y, b)
        at = b[0][1]
        for k, (c, start, end) in enumerate(b):
            noise = one.out_noise[0][c], one.out_noise[1][c]
            want = one._nce(q[start:end], one.params["out"][c], one.params["out_bias"][c], noise, y[start:end] - c * CLASS_WORDS)
            for got, expected in zip((dq[start - at:end - at], dr[k], db[k]), want):
                assert np.allclose(got, expected, rtol=1e-4, atol=1e-4)
