"""Two heads on one shared text vector: fitting, the epoch loop, saving, loading, scoring.

* Shared vector (T5): ``RegexTokenizer -> HashingTF -> IDF`` fitted on the
  train split only; for the MLP heads then a dense vector of ``RANK`` numbers
  (:mod:`sardonyx.operators.svd`).  Computed once per split and written to the
  checkpoint folder, so the per-epoch fits and evaluations read it instead of
  re-tokenising.
* Heads (G1): a 2-class and a 7-class classifier on the same vector, each with
  one hidden layer of 256 (``MultilayerPerceptronClassifier``); ``logistic``
  heads without a hidden layer are the alternative.
* Epoch loop (G4): an epoch goes on from the weights of the one before, so the
  cost is linear in the epochs.  Its train mini-batches follow the epoch's own
  order (M7).  After it both splits are scored, one history row is produced
  with :func:`epoch_table`, and the pair of heads is published when the
  validation F1 strictly improves (S6).  Only the one-row epoch summary
  reaches the driver.
* Interrupted loops: after every epoch the heads and the history are published
  in a state store; ``resume=True`` goes on from there.
* Scoring (I1-I8): one ``PipelineModel`` (features + both heads) turns a
  ``text`` column into prediction records, batch or stream alike.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.functions.numeric import argmax, cross_entropy
from sardonyx.operators.history import HISTORY_SCHEMA, epoch_log
from sardonyx.operators.permutation import epoch_position
from sardonyx.operators.ranking import batch_size_for, dense_ids, minibatches
from sardonyx.operators.scoring import predictions
from sardonyx.operators.svd import projection, sparse_rows, truncated_svd
from sardonyx.plans.epochs import epoch_table
from sardonyx.plans.model_store import ModelStore
from sardonyx.session import materialize, scratch_dir, scratch_scope

HASH_FEATURES = 1 << 16
#: Hashed features under the dense vector of the MLP heads; a pass of the SVD returns this many rows.
DENSE_FEATURES = 1 << 13
RANK = 64
FEATURES_OF = {"logistic": HASH_FEATURES, "mlp": DENSE_FEATURES}


@dataclass
class TrainResult:
    model_path: str | None
    history: DataFrame
    best_epoch: int | None
    best_val_f1: float
    model: PipelineModel | None = None   # the best pair as it is in memory


def feature_pipeline(text: str = "text", num_features: int = HASH_FEATURES) -> Pipeline:
    """T5: tokens (same rule as the vocabulary) -> hashed counts -> IDF weights."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=C.TOKEN_SPLIT_REGEX,
                       gaps=True, toLowercase=True, minTokenLength=1),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="features"),
    ])


def _apply(stages, df: DataFrame) -> DataFrame:
    for stage in stages:
        df = stage.transform(df)
    return df


def _counted(df: DataFrame, keep: list[str], width: int) -> DataFrame:
    """``keep`` and the hashed word counts of every text, written: texts are read once."""
    return materialize(_apply(feature_pipeline(num_features=width).getStages()[:2], df).select(*keep, "_tf"), "counts")


def _fit_on_counts(counts: DataFrame, kind: str, width: int, rank: int) -> list:
    """The fitted stages ``_tf -> features`` (sparse TF-IDF, or the dense vector of ``mlp``).

    The rows of the TF-IDF table have length 1 before the SVD, or the longest texts alone would set the directions.
    """
    idf = IDF(inputCol="_tf", outputCol="features" if kind != "mlp" else "_tfidf").fit(counts)
    if kind != "mlp":
        return [idf]
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit")
    rows = materialize(sparse_rows(_apply([idf, unit], counts.select("_tf")), "_unit"), "tf-idf")
    return [idf, unit, projection(counts.sparkSession, truncated_svd(rows, width, rank), "_unit", "features")]


def fit_features(train: DataFrame, kind: str = "logistic", num_features: int | None = None,
                 rank: int = RANK) -> PipelineModel:
    """T5: the fitted stages ``text -> features``; sparse TF-IDF, or for ``mlp`` a dense vector of ``rank``."""
    width = num_features or FEATURES_OF[kind]
    words = feature_pipeline(num_features=width).getStages()[:2]
    return PipelineModel([*words, *_fit_on_counts(_counted(train.select("text"), [], width), kind, width, rank)])


def _with_class_count(df: DataFrame, col: str, n: int) -> DataFrame:
    """Declare ``n`` classes on a label column (so a missing class still gets an output)."""
    meta = {"ml_attr": {"type": "nominal", "num_vals": n, "name": col}}
    return df.withColumn(col, F.col(col).cast("double").alias(col, metadata=meta))


def _head(kind: str, label: str, prefix: str, n_classes: int, iters: int, width: int,
          init_weights=None, seed: int = C.SEED):
    cols = dict(featuresCol="features", labelCol=label, predictionCol=f"{prefix}_pred",
                probabilityCol=f"{prefix}_probability", rawPredictionCol=f"{prefix}_raw")
    if kind == "mlp":
        mlp = MultilayerPerceptronClassifier(layers=[width, C.HEAD_HIDDEN, n_classes], maxIter=iters,
                                             seed=seed, blockSize=128, **cols)
        if init_weights is not None:
            mlp.setInitialWeights(init_weights)
        return mlp
    family = "binomial" if n_classes == 2 else "multinomial"
    return LogisticRegression(maxIter=iters, regParam=0.01, elasticNetParam=0.0, family=family,
                              standardization=True, tol=1e-9, **cols)


def prepare_splits(corpus: DataFrame, num_features: int | None = None, unique_keys: bool = True,
                   kind: str = "logistic", rank: int = RANK, feat: PipelineModel | None = None):
    """Fit the shared vector on train (unless given); featurise and number train and val once (written tables).

    The rank moves keys and vectors, never texts.  ``unique_keys=False`` is for
    corpora keyed by content: copies share a key.
    """
    width = num_features or FEATURES_OF[kind]
    keep = ["split", "row_key", "label", "domain_idx"]
    counts = _counted(corpus.filter(F.col("split").isin("train", "val")).select(*keep, "text"), keep, width)
    if feat is None:
        after = _fit_on_counts(counts.filter(F.col("split") == "train").select("_tf"), kind, width, rank)
        feat = PipelineModel([*feature_pipeline(num_features=width).getStages()[:2], *after])
    both = materialize(_apply(feat.stages[2:], counts).select(*keep, "features"), "features")
    d = dense_ids(both, ["split"], materialize_input=False, unique_keys=unique_keys)
    sizes = both.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))   # two rows
    d = minibatches(d.join(F.broadcast(sizes), "split"), "row_no", batch_size_for("split"))
    both = materialize(d.select("split", "row_no", "n_rows", "batch_id", "label", "domain_idx", "features"), "numbered")
    both = _with_class_count(_with_class_count(both, "label", 2), "domain_idx", len(C.DOMAIN_LABELS))
    return feat, both


def in_epoch_order(both: DataFrame, epoch: int) -> DataFrame:
    """M7: the mini-batch of every train row in the epoch's own order (other splits keep theirs)."""
    d = epoch_position(both.withColumn("_epoch", F.lit(epoch)), "n_rows", "_epoch", "row_no", "_position")
    position = F.when(F.col("split") == "train", F.col("_position")).otherwise(F.col("row_no"))
    return minibatches(d.withColumn("_position", position), "_position", batch_size_for("split")).drop("_position", "_epoch")


def _scored_epoch(both: DataFrame, s_model, d_model, epoch: int) -> DataFrame:
    out = d_model.transform(s_model.transform(in_epoch_order(both, epoch)))
    sr = vector_to_array("sarcasm_raw")
    dr = vector_to_array("domain_raw")
    return out.select(
        F.lit(epoch).alias("epoch"), "split", "batch_id",
        F.col("label").cast("int").alias("sarc_label"),
        argmax(vector_to_array("sarcasm_probability")).alias("pred"),
        cross_entropy(sr, F.col("label"), 2).alias("sarcasm_loss"),
        cross_entropy(dr, F.col("domain_idx"), len(C.DOMAIN_LABELS)).alias("domain_loss"),
    ).withColumn("total_loss", F.lit(C.SARCASM_LOSS_WEIGHT) * F.col("sarcasm_loss")
                 + F.lit(C.DOMAIN_LOSS_WEIGHT) * F.col("domain_loss"))


def train_two_heads(corpus: DataFrame, out_dir: str | None = None, epochs: int = C.NUM_EPOCHS,
                    kind: str = "mlp", iters_per_epoch: int = 10,
                    num_features: int | None = None, unique_keys: bool = True, rank: int = RANK,
                    resume: bool = False, on_epoch: Callable[[dict], None] | None = None) -> TrainResult:
    """G1 + G4 + S6: the epoch loop with best-by-val-F1 saving; returns the history.

    ``num_features`` is the width of the hashed vector (by default ``FEATURES_OF[kind]``), ``rank``
    that of the dense one.  ``on_epoch`` gets each epoch's record.  With ``resume`` a loop that ended
    early in the same ``out_dir`` goes on after its last finished epoch; the corpus and the settings
    must be the same (a changed setting starts anew).
    """
    spark = corpus.sparkSession
    out_dir = out_dir or scratch_dir(spark, "model")
    loop = _Loop(spark, out_dir, kind, iters_per_epoch, num_features or FEATURES_OF[kind], rank, unique_keys)
    with scratch_scope(spark):   # the feature table is dropped when the loop ends
        return loop.run(corpus, epochs, resume, on_epoch)


class _Loop:
    """One training run: what it needs to go on is in its state store after every epoch."""

    def __init__(self, spark, out_dir, kind, iters, width, rank, unique_keys):
        self.spark, self.kind, self.iters, self.width, self.rank = spark, kind, iters, width, rank
        self.unique_keys = unique_keys
        self.best, self.state, self.shared = (ModelStore(spark, f"{out_dir}/{n}") for n in ("best", "state", "features"))
        settings = [kind, iters, width, rank if kind == "mlp" else 0, unique_keys, C.SEED, C.HEAD_HIDDEN]
        self.settings = hashlib.sha256(json.dumps(settings).encode()).hexdigest()[:16]
        self.history: list[dict] = []
        self.best_f1, self.best_epoch, self.saved, self.model = 0.0, None, None, None

    def _restore(self):
        """The heads and the shared vector of the last finished epoch, if there is one of these settings."""
        last = self.state.latest()
        if last is None or last.meta["settings"] != self.settings:
            return None, None
        heads, _ = self.state.load(last.number)
        feat, _ = self.shared.load(last.meta["features"])
        self.history, self.best_f1, self.best_epoch, best = (
            last.meta[k] for k in ("history", "best_f1", "best_epoch", "best"))
        if best is not None:
            self.model, found = self.best.load(best)
            self.saved = found.path
        return feat, heads.stages

    def run(self, corpus, epochs, resume, on_epoch) -> TrainResult:
        feat, heads = self._restore() if resume else (None, None)
        done = len(self.history)
        if done < epochs:
            given = feat
            feat, both = prepare_splits(corpus, self.width, self.unique_keys, self.kind, self.rank, feat)
            shared = self.state.latest().meta["features"] if given else self.shared.publish(feat).number
            # Persist the feature rows once: every fit and every evaluation reuses them, and
            # a persisted input stops each classifier from caching its own copy.  A lost
            # executor re-reads its share from the written feature table.
            train = both.filter(F.col("split") == "train").persist(StorageLevel.MEMORY_AND_DISK)
            val = both.filter(F.col("split") == "val").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                for epoch in range(done + 1, epochs + 1):
                    heads = self._epoch(epoch, feat, heads, train, val, shared)
                    if on_epoch:
                        on_epoch(self.history[-1])
            finally:
                train.unpersist()
                val.unpersist()
        history = self.spark.createDataFrame(
            [tuple(r.get(c) for c in _HIST_COLS) for r in self.history[:epochs]], HISTORY_SCHEMA)
        return TrainResult(self.saved, epoch_log(history), self.best_epoch, self.best_f1, self.model)

    def _heads(self, epoch, before):
        """The two estimators of an epoch; MLP heads start from the weights of the one before."""
        n_dom = len(C.DOMAIN_LABELS)
        if self.kind == "mlp":
            width = min(self.rank, self.width)
            s, d = (m.weights for m in before) if before else (None, None)
            return [_head("mlp", "label", "sarcasm", 2, self.iters, width, s),
                    _head("mlp", "domain_idx", "domain", n_dom, self.iters, width, d)]
        # no warm start in Spark's logistic regression: refit with more iterations
        return [_head(self.kind, "label", "sarcasm", 2, self.iters * epoch, self.width),
                _head(self.kind, "domain_idx", "domain", n_dom, self.iters * epoch, self.width)]

    def _epoch(self, epoch, feat, before, train, val, shared):
        t0 = time.time()
        s_model, d_model = fit_concurrently(self._heads(epoch, before), train)
        summary = epoch_table(_scored_epoch(train.unionByName(val), s_model, d_model, epoch)).collect()   # one row
        rec = summary[0].asDict() if summary else {"epoch": epoch}
        rec["epoch_time_sec"] = time.time() - t0
        self.history.append(rec)
        if (rec.get("val_f1") or 0.0) > self.best_f1:
            self.best_f1, self.best_epoch = rec["val_f1"], epoch
            self.model = PipelineModel([*feat.stages, s_model, d_model])
            self.saved = self.best.publish(self.model, {"epoch": epoch, "val_f1": rec["val_f1"]}).path
        best = self.best.latest()
        self.state.publish(PipelineModel([s_model, d_model]), {
            "settings": self.settings, "history": self.history, "features": shared, "best_f1": self.best_f1,
            "best_epoch": self.best_epoch, "best": best.number if self.saved else None}, keep=2)
        return [s_model, d_model]


_HIST_COLS = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")]


def fit_concurrently(estimators, df: DataFrame):
    """Fit independent estimators on the same data as concurrent Spark jobs.

    Both heads read the same written feature table; running their jobs side
    by side keeps the cluster busy during each other's driver-side solver
    steps (the same idea as the ``parallelism`` option of Spark ML tuning).
    """
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=len(estimators)) as pool:
        return [f.result() for f in [pool.submit(e.fit, df) for e in estimators]]


def fit_heads(corpus: DataFrame, kind: str = "logistic", iters: int = 10,
              num_features: int | None = None, rank: int = RANK) -> PipelineModel:
    """One fit of the shared vector and both heads on the train split."""
    train = corpus.filter(F.col("split") == "train")
    train = _with_class_count(_with_class_count(train, "label", 2), "domain_idx", len(C.DOMAIN_LABELS))
    feat = fit_features(train, kind, num_features, rank)
    width = num_features or FEATURES_OF[kind]
    width = min(rank, width) if kind == "mlp" else width
    heads = [_head(kind, "label", "sarcasm", 2, iters, width),
             _head(kind, "domain_idx", "domain", len(C.DOMAIN_LABELS), iters, width)]
    vectors = feat.transform(train).select("label", "domain_idx", "features")
    return PipelineModel([*feat.stages, *fit_concurrently(heads, vectors)])


def save_model(model: PipelineModel, path: str, meta: dict | None = None) -> str:
    """Features and both heads published together as the latest version of the store ``path``."""
    ModelStore(SparkSession.getActiveSession(), path).publish(model, meta)
    return path


def load_model(path: str, version: int | None = None) -> PipelineModel:
    """A published version (the latest) of a store, or the model folder that a version names."""
    store = ModelStore(SparkSession.getActiveSession(), path)
    return store.load(version)[0] if version is not None or store.numbers() else PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame, keep=("text",)) -> DataFrame:
    """I8: prediction records for every row of ``df`` (a ``text`` column), batch or stream.

    A NULL text is scored, and shown, as the empty text.
    """
    out = model.transform(df.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return predictions(out, vector_to_array("sarcasm_probability"), vector_to_array("domain_probability"),
                       keep=list(keep))


def predict(model: PipelineModel, spark: SparkSession, text: str) -> dict:
    """One text -> one record without the text (a one-row job)."""
    df = spark.createDataFrame([(text,)], "text string")
    row = score(model, df, keep=()).first()
    return row.asDict(recursive=True)


def evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Score rows with known ``label``/``domain_idx``: the scored table for the reports.

    ``row_key``, where given, is kept: batches follow the split's own order.
    """
    out = model.transform(df.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    sp = vector_to_array("sarcasm_probability")
    return out.select(
        *[c for c in ("row_key",) if c in df.columns], "label", "domain_idx", F.element_at(sp, 2).alias("score"),
        argmax(sp).alias("pred"),
        cross_entropy(vector_to_array("sarcasm_raw"), F.col("label"), 2).alias("sarcasm_loss"),
        cross_entropy(vector_to_array("domain_raw"), F.col("domain_idx"), len(C.DOMAIN_LABELS))
        .alias("domain_loss"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean -> split -> fit both heads -> score the test split -> accuracy per domain (7 rows)."""
    from sardonyx.operators.metrics import domain_accuracy
    from sardonyx.plans.catalog import labelled_corpus
    c = labelled_corpus(spark, sf_dir)
    model = fit_heads(c)
    return domain_accuracy(evaluate(model, c.filter(F.col("split") == "test")))
