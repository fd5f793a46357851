"""CSV / JSON-lines edge cases, encoding shape rules, and stream = batch."""

import os

import pytest
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.operators.encode import build_vocabulary, encode, encoding_violations
from sardonyx.sources.files import read_forum_csv, read_headlines

CSV_TEXT = (
    "label,comment,author,subreddit\n"
    '1,"He said ""sure"", right",bob,politics\n'
    "0,too few\n"
    "1,too,many,fields,here,really\n"
    '1,"line\nbreak",joe,movies\n'
    "0,#N/A N/A,zed,null\n"
    "x,bad label row,amy,nba\n"
)


SENTENCES = ["Well, that went brilliantly.", "Rain is expected in the north tomorrow.", "What a surprise, the bus is late.",
             "The library opens at nine.", "Lovely, the printer is broken again.", "She won the regional chess final."]


def test_forum_csv_edge_lines(spark, tmp_path):
    p = tmp_path / "forum.csv"
    p.write_text(CSV_TEXT, encoding="utf-8")
    rows = [tuple(r) for r in read_forum_csv(spark, str(p)).collect()]
    assert ("1", 'He said "sure", right', "politics") in rows
    assert ("0", "too few", None) in rows
    assert ("1", "too", "fields") in rows
    assert ("1", "line\nbreak", "movies") in rows
    assert ("0", None, None) in rows
    assert len(rows) == 6


def test_headline_json_lines(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text('{"is_sarcastic": 1, "headline": "a b c d e f g", "article_link": "https://x.com/nba/1"}\n'
                 "\n   \n"
                 '{"is_sarcastic": 0, "headline": "no link here at all"}\n', encoding="utf-8")
    rows = read_headlines(spark, str(p)).orderBy("headline").collect()
    assert len(rows) == 2
    assert rows[1]["article_link"] is None and rows[0]["is_sarcastic"] == "1"


def test_malformed_json_fails(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text('{"is_sarcastic": 1, "headline": "ok"}\n{not json\n', encoding="utf-8")
    with pytest.raises(Exception):
        read_headlines(spark, str(p)).collect()


def _texts(spark):
    texts = ["Hello, world! Hello again.", "......", "one " * 300, "Ünïcode wörds çà và"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")


def test_encoding_shapes(spark):
    df = _texts(spark)
    vocab = build_vocabulary(df, size=8)   # 4 specials + 4 words
    assert vocab.count() == 4
    enc = encode(df, vocab, keys=["id"])
    rows = {r["id"]: r for r in enc.collect()}
    for r in rows.values():
        assert len(r["input_ids"]) == C.MAX_SEQ_LENGTH == len(r["attention_mask"])
        assert r["input_ids"][0] == C.CLS_ID
    assert rows[1]["input_ids"][:3] == [C.CLS_ID, C.SEP_ID, C.PAD_ID] and rows[1]["n_tokens"] == 0
    assert rows[2]["n_tokens"] == 300 and sum(rows[2]["attention_mask"]) == C.MAX_SEQ_LENGTH
    assert rows[2]["input_ids"][-1] == C.SEP_ID
    assert C.UNK_ID in rows[3]["input_ids"]
    v = {r["rule"]: r["n_violations"] for r in encoding_violations(enc).collect()}
    assert set(v.values()) == {0}


def test_encoding_without_a_shuffle_equals_the_join(spark, monkeypatch):
    from sardonyx.operators import encode as EN
    texts = ["a b c", None, "", "été ÜBER 中文 x1", 'quote " back\\slash', "a " * 200, "unknown words only"]
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts * 3)], "id bigint, text string").repartition(4)
    vocab = build_vocabulary(spark.createDataFrame([("a b c été über 中文 x1 quote back slash " + " ".join(f"w{i}" for i in range(3000)),)],
                                                   "text string"))
    plan = encode(df, vocab, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition above
    fast = sorted(map(repr, encode(df, vocab, ["id"]).collect()))
    monkeypatch.setattr(EN, "CONSTANT_TOKENS", 100)
    joined = encode(df, vocab, ["id"])
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert fast == sorted(map(repr, joined.collect())) and len(fast) == 21


def test_vocabulary_order(spark):
    df = spark.createDataFrame([("b a a c c",)], "text string")
    got = [(r["token"], r["token_id"]) for r in build_vocabulary(df).orderBy("token_id").collect()]
    assert got == [("a", 4), ("c", 5), ("b", 6)]


def test_stream_equals_batch(spark, tmp_path):
    from sardonyx.plans.training import fit_heads, score
    from sardonyx.streaming.scoring import run_available
    rows = [(i, "this is great " * (i % 5 + 1) if i % 2 else "terrible sad news " * (i % 3 + 1),
             i % 2, i % 7, ["train", "train", "val", "test"][i % 4]) for i in range(80)]
    corpus = spark.createDataFrame(rows, "id bigint, text string, label int, domain_idx int, split string")
    model = fit_heads(corpus, iters=5)
    src = tmp_path / "in"
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(SENTENCES + ["ab", "  ab  ", "abc"])],
                                  "id bigint, text string")
    texts.write.parquet(str(src))
    streamed = run_available(spark, str(src), "id bigint, text string", model, keep=["id", "text"],
                             sink_path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ckpt"))
    from sardonyx.operators.scoring import prompt_guard
    batch = score(model, prompt_guard(texts), keep=["id", "text"])
    norm = lambda df: sorted((r["id"], r["sarcasm_score"], r["domain"]) for r in df.collect())
    assert norm(streamed) == norm(batch)
    assert len(norm(streamed)) == len(SENTENCES) + 1


def test_model_save_load_same_scores(spark, tmp_path):
    from sardonyx.plans.training import fit_heads, load_model, save_model, score
    rows = [(i, f"word{i % 3} text body {i % 5}", i % 2, i % 7, "train") for i in range(40)]
    corpus = spark.createDataFrame(rows, "id bigint, text string, label int, domain_idx int, split string")
    m = fit_heads(corpus, iters=3)
    path = save_model(m, str(tmp_path / "m"))
    a = sorted(tuple(r) for r in score(m, corpus, keep=["id"]).drop("all_domain_scores").collect())
    b = sorted(tuple(r) for r in score(load_model(path), corpus, keep=["id"]).drop("all_domain_scores").collect())
    assert a == b


def test_stream_restart_has_no_duplicates(spark, tmp_path):
    from sardonyx.plans.training import fit_heads
    from sardonyx.streaming.scoring import run_available
    rows = [(i, f"text number {i} with words", i % 2, i % 7, "train") for i in range(30)]
    model = fit_heads(spark.createDataFrame(rows, "id bigint, text string, label int, domain_idx int, split string"),
                      iters=2)
    src = tmp_path / "in"
    spark.createDataFrame([(1, "first batch text")], "id bigint, text string").write.parquet(str(src / "a"))
    kw = dict(keep=["id", "text"], sink_path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ckpt"))
    first = run_available(spark, str(src / "*"), "id bigint, text string", model, **kw)
    assert first.count() == 1
    spark.createDataFrame([(2, "second batch text")], "id bigint, text string").write.parquet(str(src / "b"))
    second = run_available(spark, str(src / "*"), "id bigint, text string", model, **kw)
    assert sorted(r["id"] for r in second.collect()) == [1, 2]


def test_mlp_heads_continue_across_epochs(spark):
    from sardonyx.plans.training import train_two_heads
    rows = [(i, ("good great fine " if i % 2 else "bad awful poor ") * (1 + i % 3), i % 2, i % 7,
             "test" if i % 10 == 0 else ("val" if i % 10 == 1 else "train"),
             f"{i:032x}") for i in range(200)]
    corpus = spark.createDataFrame(rows, "id bigint, text string, label int, domain_idx int, split string, row_key string")
    r = train_two_heads(corpus, epochs=2, kind="mlp", iters_per_epoch=5)
    h = r.history.orderBy("epoch").collect()
    assert len(h) == 2 and h[1]["train_loss"] <= h[0]["train_loss"]
    assert r.best_epoch in (1, 2) and r.model_path


def test_predict_single_text(spark):
    from sardonyx.plans.training import fit_heads, predict
    rows = [(i, f"sample {i % 4} words here", i % 2, i % 7, "train") for i in range(30)]
    m = fit_heads(spark.createDataFrame(rows, "id bigint, text string, label int, domain_idx int, split string"),
                  iters=2)
    rec = predict(m, spark, SENTENCES[0])
    assert set(rec) == {"sarcasm_score", "is_sarcastic", "domain", "domain_confidence", "all_domain_scores"}
    assert len(rec["all_domain_scores"]) == len(C.DOMAIN_LABELS)
    assert 0.0 <= rec["sarcasm_score"] <= 1.0 and rec["domain"] in C.DOMAIN_LABELS


def _planted(spark, n=400):
    import random
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        y = rnd.randint(0, 1)
        words = ["oh", "sure", "totally", "great"] if y else ["report", "shows", "growth", "steady"]
        filler = rnd.choice(["the", "a", "this", "that"])
        text = " ".join(rnd.choice(words) for _ in range(6)) + " " + filler
        rows.append((i, text, y, i % 7, "val" if i % 5 == 0 else "train"))
    return spark.createDataFrame(rows, "id bigint, text string, label int, domain_idx int, split string")


def test_planted_signal_beats_majority_and_reruns_agree(spark):
    from sardonyx.operators.metrics import accuracy_f1
    from sardonyx.plans.training import evaluate, fit_heads
    corpus = _planted(spark)
    val = corpus.filter("split = 'val'")
    majority = max(val.filter("label = 1").count(), val.filter("label = 0").count()) / val.count()
    m1 = fit_heads(corpus, iters=10)
    acc = accuracy_f1(evaluate(m1, val)).first()["accuracy"]
    assert acc > majority
    m2 = fit_heads(corpus, iters=10)
    a = sorted(tuple(r) for r in evaluate(m1, val).collect())
    b = sorted(tuple(r) for r in evaluate(m2, val).collect())
    assert a == b


def test_null_text_is_scored_as_empty(spark):
    from sardonyx.plans.training import evaluate, fit_heads, score
    rows = [(i, f"sample {i % 4} words here", i % 2, i % 7, "train") for i in range(30)]
    m = fit_heads(spark.createDataFrame(rows, "id bigint, text string, label int, domain_idx int, split string"), iters=2)
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "words here")], "id bigint, text string")
    got = {r["id"]: (r["sarcasm_score"], r["domain"], r["text"]) for r in score(m, texts, ["id", "text"]).collect()}
    assert len(got) == 3 and got[1] == got[2] and got[1][2] == ""
    known = spark.createDataFrame([("k", None, 1, 0)], "row_key string, text string, label int, domain_idx int")
    assert evaluate(m, known).first()["row_key"] == "k"


def test_csv_files_with_different_headers_fail(spark, tmp_path):
    from sardonyx.sources.files import read_forum_csv
    (tmp_path / "a.csv").write_text("label,comment,author,subreddit\n1,hello world,z,x\n")
    (tmp_path / "b.csv").write_text("comment,label,subreddit,author\nhello world b,0,y,z\n")
    with pytest.raises(Exception, match="CSV header"):
        read_forum_csv(spark, str(tmp_path)).collect()
    (tmp_path / "b.csv").write_text("label,comment,author,subreddit\n0,hello world b,z,y\n")
    assert sorted(r["label"] for r in read_forum_csv(spark, str(tmp_path)).collect()) == ["0", "1"]


def test_stream_over_a_table_that_is_a_folder(spark, tmp_path):
    import shutil

    from sardonyx.plans.catalog import QUERIES
    from tests.conftest import SF_SMALL
    for t in ("documents", "labels", "pages"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    conv.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["score_stream_checks"](spark, str(tmp_path))
    want = QUERIES["score_stream_checks"](spark, SF_SMALL)
    assert got.count() == want.count() and got.filter("equals_batch").count() == got.count()


def test_vocabulary_cut_inside_a_tie(spark):
    from collections import Counter
    texts = [f"common w{i % 50} tie{i:03d} tx{i:03d}" for i in range(200)]
    counts = Counter(w for t in texts for w in t.split())
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    for size in (3, 40, 51, 52, 120, 250, 300, 451, 1000):
        got = build_vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"),
                               size=size + C.FIRST_TOKEN_ID).orderBy("token_id").collect()
        assert [(r["token"], r["n"]) for r in got] == want[:size]


def test_batches_of_copies_that_share_a_key(spark):
    from sardonyx.plans.training import prepare_splits

    corpus = spark.range(0, 300, 1, 6).selectExpr(
        "'train' as split", "md5(if(id < 200, 'copy', cast(id as string))) as row_key", "cast(id % 2 as int) as label",
        "cast(id % 7 as int) as domain_idx", "if(id < 200, 'same text', concat('text ', id)) as text")
    _, both = prepare_splits(corpus, 64, unique_keys=False)
    sizes = {r["batch_id"]: r["count"] for r in both.groupBy("batch_id").count().collect()}
    size = max(sizes.values())
    assert sum(sizes.values()) == 300 and [sizes[k] for k in sorted(sizes)][:-1] == [size] * (len(sizes) - 1)
