"""The epoch loop: carried weights, falling loss, resuming, and the versioned model store."""

import threading

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.sql import functions as F

from sardonyx.plans import training as TR
from sardonyx.plans.model_store import ModelStore

METRICS = ["epoch", "train_loss", "val_loss", "train_f1", "val_f1", "train_acc", "val_acc"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Two words tell the label and one the domain; copies and rows without words are among them."""
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} topic{i % 7} " * (1 + i % 3) if i % 37 else "", i % 2, i % 7,
             "test" if i % 10 == 0 else "val" if i % 10 == 1 else "train", f"{i * 2654435761 % 2**32:032x}")
            for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, text string, label int, domain_idx int, split string, row_key string")


def history(result):
    return [tuple(r[c] for c in METRICS) for r in result.history.orderBy("epoch").collect()]


@pytest.fixture(scope="module")
def whole(spark, corpus):
    return TR.train_two_heads(corpus, epochs=4, num_features=256, rank=12)


def test_loss_falls_from_epoch_to_epoch(whole):
    h = history(whole)
    assert [r[0] for r in h] == [1, 2, 3, 4]
    assert all(b[1] <= a[1] + 1e-3 for a, b in zip(h, h[1:])) and h[3][1] < h[0][1]
    assert h[3][4] > 0.9 and whole.best_epoch in (1, 2, 3, 4)


def test_heads_have_one_hidden_layer_of_256(whole):
    s, d = whole.model.stages[-2:]
    assert len(s.weights) == (12 + 1) * 256 + (256 + 1) * 2 and len(d.weights) == (12 + 1) * 256 + (256 + 1) * 7


def test_reloaded_model_equals_the_one_in_memory(whole, corpus):
    a, b = (sorted(tuple(r) for r in TR.score(m, corpus, keep=["id"]).drop("all_domain_scores").collect())
            for m in (whole.model, TR.load_model(whole.model_path)))
    assert a == b and len(a) == 600


def test_an_epoch_costs_the_same_however_many_came_before(spark, corpus, monkeypatch):
    asked = []
    monkeypatch.setattr(TR, "fit_concurrently", lambda heads, df, fit=TR.fit_concurrently: (
        asked.append([h.getMaxIter() for h in heads]), fit(heads, df))[1])
    TR.train_two_heads(corpus, epochs=3, num_features=64, rank=4, iters_per_epoch=2)
    assert asked == [[2, 2]] * 3


class Killed(Exception):
    pass


def test_a_killed_loop_goes_on(spark, corpus, whole, tmp_path):
    def kill(record):
        if record["epoch"] == 2:
            raise Killed
    args = dict(out_dir=str(tmp_path / "m"), epochs=4, num_features=256, rank=12)
    with pytest.raises(Killed):
        TR.train_two_heads(corpus, on_epoch=kill, **args)
    seen = []
    again = TR.train_two_heads(corpus, resume=True, on_epoch=lambda r: seen.append(r["epoch"]), **args)
    assert seen == [3, 4]
    for a, b in zip(history(again), history(whole)):
        assert a == pytest.approx(b, abs=2e-3)
    assert again.best_epoch == whole.best_epoch and TR.load_model(again.model_path).stages
    done = TR.train_two_heads(corpus, resume=True, on_epoch=lambda r: seen.append(r["epoch"]), **args)
    assert seen == [3, 4] and history(done) == history(again)
    more = TR.train_two_heads(corpus, resume=True, **{**args, "epochs": 5})
    assert history(more)[:4] == history(again) and len(history(more)) == 5


def test_other_settings_start_anew(spark, corpus, tmp_path):
    seen = []
    for rank in (4, 5):
        TR.train_two_heads(corpus, str(tmp_path / "m"), epochs=1, num_features=64, rank=rank, iters_per_epoch=2,
                           resume=True, on_epoch=lambda r: seen.append(r["epoch"]))
    assert seen == [1, 1]


def small_model(spark, width):
    return Pipeline(stages=[Tokenizer(inputCol="text", outputCol="t"),
                            HashingTF(inputCol="t", outputCol="f", numFeatures=width)]).fit(
        spark.createDataFrame([("a b",)], "text string"))


def test_store_versions(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "s"))
    assert store.latest() is None and store.numbers() == []
    with pytest.raises(FileNotFoundError):
        store.load()
    for n in range(1, 6):
        v = store.publish(small_model(spark, n + 1), {"n": n}, keep=3)
        assert v.number == n and store.latest() == v
    assert store.numbers() == [3, 4, 5]
    model, v = store.load(4)
    assert model.stages[1].getNumFeatures() == 5 and v.meta == {"n": 4}


def test_a_crashed_save_leaves_the_old_model(spark, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path / "s"))
    first = store.publish(small_model(spark, 4))
    monkeypatch.setattr(ModelStore, "_claim", lambda self: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        store.publish(small_model(spark, 8))
    monkeypatch.undo()
    assert store.latest() == first and store.load()[0].stages[1].getNumFeatures() == 4
    # a writer that died after it took a number leaves a gap
    store._claim()
    assert store.publish(small_model(spark, 16)).number == 3 and store.numbers() == [1, 3]


def test_loading_while_saving_never_fails(spark, tmp_path):
    store, errors, stop = ModelStore(spark, str(tmp_path / "s")), [], threading.Event()
    store.publish(small_model(spark, 2))

    def save():
        try:
            for n in range(3, 9):
                store.publish(small_model(spark, n))
        except Exception as e:  # noqa: BLE001
            errors.append(e)
        stop.set()

    writer = threading.Thread(target=save)
    writer.start()
    widths = []
    while not stop.is_set() or not widths:
        widths.append(store.load()[0].stages[1].getNumFeatures())
    writer.join()
    assert errors == [] and widths == sorted(widths) and store.load()[0].stages[1].getNumFeatures() == 8


def test_two_writers_publish_different_versions(spark, tmp_path):
    store, got = ModelStore(spark, str(tmp_path / "s")), []
    threads = [threading.Thread(target=lambda k=k: got.append(store.publish(small_model(spark, k), keep=0).number))
               for k in (2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3] and store.numbers() == [1, 2, 3]


def test_save_and_load_by_path(spark, tmp_path):
    m = small_model(spark, 6)
    path = TR.save_model(m, str(tmp_path / "m"))
    TR.save_model(small_model(spark, 7), path)
    assert TR.load_model(path).stages[1].getNumFeatures() == 7
    assert TR.load_model(path, 1).stages[1].getNumFeatures() == 6
    plain = str(tmp_path / "plain")
    m.write().save(plain)
    assert isinstance(TR.load_model(plain), PipelineModel)


def test_batches_change_with_the_epoch(spark, corpus):
    _, both = TR.prepare_splits(corpus, 64, kind="mlp", rank=4)
    rows = {e: {(r["split"], r["row_no"]): r["batch_id"] for r in TR.in_epoch_order(both, e).collect()} for e in (1, 2)}
    assert all(rows[1][k] == rows[2][k] for k in rows[1] if k[0] == "val")
    train = [k for k in rows[1] if k[0] == "train"]
    assert sum(rows[1][k] == rows[2][k] for k in train) < len(train) / 4
    assert sorted(rows[1][k] for k in train) == sorted(rows[2][k] for k in train)
    assert both.where(F.col("features").isNull()).count() == 0
