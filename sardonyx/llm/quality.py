"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a fixed vector of statistics of its bytes, words, lines and
repeats (``FEATURES``); ids, labels, language and source are never inputs.
Trees are fitted in numpy on at most ``FIT_ROWS`` labelled rows (a documented
bound; which rows is decided by a hash of the id), on quantile bins: each
level of a tree takes one histogram of gradients per node and feature.  The
fitted trees are flattened into arrays of features, thresholds and leaf values
in heap order and broadcast (a few hundred KB); tasks walk all trees of a
batch at once in numpy.

Defined results: NULL texts count as empty and get a score like any other;
labels of NULL quality are no labels, and of several labels of an id the
lowest counts; without labels of both kinds the score is the smoothed share of
label 1 (0.5 without any); repeated documents give a row each.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from sardonyx.llm.common import arrow_map, crc_mod, fresh, hash_share, texts_of

FIT_ROWS = 30_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
L2, LEAST_HESSIAN = 1.0, 4.0
THRESHOLD = 0.5

FEATURES = ("log_bytes", "log_words", "log_lines", "word_len", "word_len_sd", "longest_word", "upper", "digit",
            "symbol", "exclaim", "comma", "full_stop", "pipe", "other_punct", "high_byte", "space", "entropy",
            "distinct_words", "top_word", "once_words", "symbol_words", "upper_words", "digit_words",
            "repeated_lines", "line_words", "repeated_pairs", "stop_end", "bracket", "slash_at")

# ---- fixed values: byte classes
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#$%&*~^_+=<>",
            "exclaim": b"!?", "comma": b",;:", "full_stop": b".", "pipe": b"|", "other_punct": b"'\"`-",
            "high_byte": bytes(range(128, 256)), "space": b" \t\n\r", "bracket": b"()[]{}", "slash_at": b"/\\@"}
_CLASS_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_TABLE[list(_bytes), _k] = 1
_MARKS = set(b"#$%&*~^_+=<>!")


def statistics(text: bytes) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256)
    share = dict(zip(_CLASSES, ((hist @ _CLASS_TABLE) / max(n, 1)).tolist()))
    p = hist[hist > 0] / max(n, 1)
    words = text.split()
    w = len(words)
    seen = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, w) if w else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:]))) if w > 1 else 0
    heads = list(seen.items())
    d = max(w, 1)
    upper = sum(c for x, c in heads if len(x) > 1 and x.isupper())
    marked = sum(c for x, c in heads if x[-1] in _MARKS)
    digits = sum(c for x, c in heads if x[:1].isdigit())
    f = {
        "log_bytes": np.log1p(n), "log_words": np.log1p(w), "log_lines": np.log1p(len(lines)),
        "word_len": lens.mean(), "word_len_sd": lens.std(), "longest_word": np.log1p(lens.max()),
        "entropy": float(-(p * np.log2(p)).sum()) if n else 0.0,
        "distinct_words": len(seen) / d, "top_word": max(seen.values(), default=0) / d,
        "once_words": sum(c == 1 for _, c in heads) / d, "symbol_words": marked / d,
        "upper_words": upper / d, "digit_words": digits / d,
        "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1), "line_words": w / max(len(lines), 1),
        "repeated_pairs": 1 - pairs / max(w - 1, 1) if w > 1 else 0.0,
        "stop_end": float(text.rstrip()[-1:] in (b".", b"!", b"?")), **share,
    }
    return [float(f[k]) for k in FEATURES]


def statistics_of(texts) -> np.ndarray:
    rows = [statistics(t) for t in texts]
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


@dataclass
class Trees:
    """Boosted trees of one depth, as arrays in heap order."""
    base: float
    feature: np.ndarray    # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same; a row goes right above it
    leaf: np.ndarray       # (trees, 2**depth)

    def scores(self, x: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Probabilities of label 1, a slice of rows through all trees at once."""
        out = np.empty(len(x))
        inner = self.feature.shape[1]
        tree = np.arange(len(self.feature))
        for at in range(0, len(x), rows):
            part = x[at:at + rows]
            total = np.full(len(part), self.base)
            if len(tree):
                node = np.zeros((len(part), len(tree)), np.int64)
                row = np.arange(len(part))[:, None]
                while node[0, 0] < inner:
                    right = part[row, self.feature[tree, node]] > self.threshold[tree, node]
                    node = 2 * node + 1 + right
                total += self.leaf[tree, node - inner].sum(axis=1)
            out[at:at + rows] = 1 / (1 + np.exp(-total))
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
              rate: float = RATE) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base, inner = float(np.log(share / (1 - share))), 2 ** depth - 1
    empty = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2 ** depth)))
    if n == 0 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * bins  # one histogram over all features
    margin = np.full(n, base)
    feature, threshold, leaf = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                                np.zeros((trees, 2 ** depth)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            size = 2 ** level
            at = (node[:, None] * (width * bins) + flat).ravel()
            hist = [np.bincount(at, np.repeat(v, width), size * width * bins).reshape(size, width, bins)
                    for v in (g, h)]
            left = [v.cumsum(axis=2)[:, :, :-1] for v in hist]
            both = [v.sum(axis=2, keepdims=True) for v in hist]
            right = [b - v for b, v in zip(both, left)]
            gain = sum(a ** 2 / (b + L2) for a, b in (left, right)) - both[0] ** 2 / (both[1] + L2)
            gain[(left[1] < LEAST_HESSIAN) | (right[1] < LEAST_HESSIAN)] = 0
            best = gain.reshape(size, -1).argmax(axis=1)  # ties: the first feature and cut
            for k in range(size):
                j, c = divmod(int(best[k]), bins - 1)
                if gain[k, j, c] > 1e-9 and c < len(cuts[j]):
                    feature[t, size - 1 + k], threshold[t, size - 1 + k] = j, cuts[j][c]
            here = size - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, here]] > threshold[t, here])
        sums = [np.bincount(node, v, 2 ** depth) for v in (g, h)]
        leaf[t] = -rate * sums[0] / (sums[1] + L2)
        margin += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, held_out=None) -> Trees:
    """Fit on labelled rows for which ``held_out`` (a column over ``doc_id``) is not true."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    if total > most:
        known = known.where(hash_share("doc_id", most, total)).limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("quality", "text")

    def run(batches):
        for b in batches:
            x = statistics_of(texts_of(b))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.float64()),
                 pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))],
                ["y", "x"])

    # ids that repeat in docs must not undo the bound; what is cut are feature rows, after the map
    got = arrow_map(rows, run, "y double, x array<double>").limit(2 * most).toArrow()
    y = (got["y"].to_numpy() > 0).astype(float)
    x = got["x"].combine_chunks()
    x = x.values.to_numpy(zero_copy_only=False).reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, y))  # the fit must not depend on arrival order
    return fit_trees(x[order], y[order])


def score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score as ``name``."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            s = box.value.scores(statistics_of(texts_of(b, b.schema.names[at])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, name])

    schema = StructType(list(docs.schema.fields)).add(name, DoubleType())
    return arrow_map(docs, run, schema)


def held_out_column():
    return crc_mod("doc_id", 3) == 1


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; a third of the ids is never learnt from."""
    model = fit(docs, labels, held_out=held_out_column())
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out_column().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    model = fit(docs, labels, held_out=held_out_column())
    name = fresh(docs, "_score")
    return score(docs, model, name).where(F.col(name) >= threshold).drop(name)
