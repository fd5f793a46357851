"""Best-epoch rules, history round trip, prediction records, cards and the prompt guard."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sardonyx.functions.numeric import softmax
from sardonyx.operators import history as H
from sardonyx.operators.scoring import percent_text, predictions, prompt_guard, ranked_domain_scores, score_cards
from sardonyx.sources.files import read_history, write_history

# The published four-epoch history (metrics at 4 dp, seconds at 1 dp).
PUBLISHED_HISTORY = [
    {"epoch": 1, "train_loss": 0.6263, "train_sarc_loss": 0.5333, "train_acc": 0.7235, "train_f1": 0.7232,
     "val_loss": 0.5666, "val_sarc_loss": 0.4857, "val_acc": 0.7604, "val_f1": 0.7603, "epoch_time_sec": 899.6},
    {"epoch": 2, "train_loss": 0.5233, "train_sarc_loss": 0.4332, "train_acc": 0.7939, "train_f1": 0.7937,
     "val_loss": 0.5636, "val_sarc_loss": 0.4868, "val_acc": 0.7679, "val_f1": 0.7678, "epoch_time_sec": 882.6},
    {"epoch": 3, "train_loss": 0.4583, "train_sarc_loss": 0.3575, "train_acc": 0.8383, "train_f1": 0.8383,
     "val_loss": 0.5802, "val_sarc_loss": 0.5118, "val_acc": 0.7645, "val_f1": 0.7645, "epoch_time_sec": 881.1},
    {"epoch": 4, "train_loss": 0.407, "train_sarc_loss": 0.2948, "train_acc": 0.8723, "train_f1": 0.8723,
     "val_loss": 0.6284, "val_sarc_loss": 0.577, "val_acc": 0.7626, "val_f1": 0.7626, "epoch_time_sec": 881.0},
]


def _hist(spark, f1s):
    rows = [(i + 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, f, 1.0) for i, f in enumerate(f1s)]
    return spark.createDataFrame(rows, H.HISTORY_SCHEMA)


def test_best_epoch_earliest_maximum(spark):
    b = H.best_epoch(_hist(spark, [0.5, 0.6, 0.6])).first()
    assert b["best_epoch"] == 2


def test_best_epoch_none_when_all_zero(spark):
    assert H.best_epoch(_hist(spark, [0.0, 0.0])).count() == 0
    assert H.best_epoch_rounded(_hist(spark, [0.0, 0.0])).first()["best_epoch"] == 1


def test_published_history_read_and_best(spark, tmp_path):
    src = tmp_path / "training_history.json"
    src.write_text(json.dumps(PUBLISHED_HISTORY, indent=2))
    h = read_history(spark, str(src))
    assert h.count() == 4
    assert H.best_epoch(h).first()["best_epoch"] == 2
    assert H.best_epoch_rounded(h).first()["val_f1_rounded"] == pytest.approx(0.7678)
    curves = H.training_curves(h)
    assert curves.count() == 24
    out = str(tmp_path / "hist")
    write_history(H.epoch_log(h), out)
    back = read_history(spark, out)
    assert sorted(back.collect()) == sorted(H.epoch_log(h).collect())
    text = open([os.path.join(out, f) for f in os.listdir(out) if f.startswith("part-")][0]).read()
    assert isinstance(json.loads(text), list)


def _probs(spark, s1, dom):
    df = spark.createDataFrame([([1 - s1, s1], dom)], "sp array<double>, dp array<double>")
    return df


def test_flag_uses_unrounded_score(spark):
    for s, flag in [(0.5, False), (0.50004, True)]:
        r = predictions(_probs(spark, s, [1 / 7] * 7), "sp", "dp").first()
        assert r["is_sarcastic"] is flag and r["sarcasm_score"] == 0.5


def test_argmax_ties_lowest_index_and_rank_in_label_order(spark):
    dom = [0.1, 0.3, 0.3, 0.1, 0.1, 0.05, 0.05]
    r = predictions(_probs(spark, 0.2, dom), "sp", "dp").first()
    assert r["domain"] == "entertainment"
    assert r["all_domain_scores"]["technology"] == 0.3
    ranked = ranked_domain_scores(_probs(spark, 0.2, dom), "dp").orderBy("rank").collect()
    assert [x["domain"] for x in ranked][:3] == ["entertainment", "technology", "politics"]


def test_score_card(spark):
    p = predictions(_probs(spark, 0.7, [0.4567, 0.1, 0.1, 0.1, 0.1, 0.1, 0.0433]), "sp", "dp")
    c = score_cards(p).first()
    assert c["verdict"] == "SARCASTIC"
    assert c["score_bar"].count("█") == 21 and len(c["score_bar"]) == 30
    assert c["domain_upper"] == "POLITICS" and c["confidence_text"] == "45.7%"
    assert c["score_text"] == "0.7000"


def test_percent_text(spark):
    df = spark.createDataFrame([(0.4565,), (1.0,), (0.0,)], "x double")
    assert [r[0] for r in df.select(percent_text(F.col("x"))).collect()] == ["45.7%", "100.0%", "0.0%"]


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, -50.0],)], "z array<double>")
    assert sum(df.select(softmax("z")).first()[0]) == pytest.approx(1.0)


def test_prompt_guard(spark):
    df = spark.createDataFrame([("ab",), ("  ab  ",), ("abc",), ("quit now",), (" QUIT ",), ("Quit",)],
                               "text string")
    assert sorted(r[0] for r in prompt_guard(df).collect()) == ["abc", "quit now"]
