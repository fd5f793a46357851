"""Language-model scores of whole texts: corpus counts, a trained model, two scores per document.

1. Word counts of all training texts (partial counts in the tasks, summed by a
   shuffle).  The most frequent words (a bounded head) are broadcast.
2. The log-bilinear model of ``lbl`` is trained on every training text: each
   round gives the current parameters (about 1 MB) to all tasks, every task
   streams its own texts through NCE steps, and the tasks' parameters are
   averaged, weighted by tokens, in a tree of small groups.  The rounds share
   the training texts out by a hash, so each is used once.
3. Every text is scored.  Words outside the output vocabulary get the model's
   probability of that class times their smoothed unigram share within it, so
   the score is a proper distribution over all words.  Counts of head words are
   at hand; the other words' frequencies are joined with the count table.

A text's tokens are its words and one end token, written as the empty word.

Defined results: NULL texts are empty and hold the end token alone; without
training texts every count is 0 and the model stays the uniform start; rows
that repeat an id get a row each; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sardonyx.llm.common import PieceLists, arrow_map, space_words, stored, texts_of, with_row
from sardonyx.llm.lbl import CONTEXT, LogBilinear, pack, unpack
from sardonyx.llm.token_counts import frequent_pieces

HEAD_WORDS, IN_WORDS, OUT_WORDS = 131_072, 8192, 2048
#: Context ids of words outside the input vocabulary, by their last bytes.
BUCKETS = 256
ROUNDS = 2
#: Minibatch rows: the first and the largest, doubled every GROW_STEPS steps.
BATCH, BATCH_MOST, GROW_STEPS = 512, 4096, 32
FLUSH_WORDS = 150_000
SCORE_TOKENS = 1 << 15
AVERAGED = 16
_BLOCK = 1 << 14
END = ""


def word_counts(docs: DataFrame) -> DataFrame:
    """``piece, n``: how often each word (and the end token) occurs in all texts."""
    def flush(seen: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()),
                                           pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    def count(batches):
        seen, ends = Counter(), 0
        for batch in batches:
            for text in texts_of(batch):
                ends += 1
                seen.update(space_words(text))
                if len(seen) >= FLUSH_WORDS:
                    yield flush(seen)
                    seen = Counter()
        if ends:
            seen[END.encode()] = ends
            yield flush(seen)

    return arrow_map(docs.select("text"), count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The head words by rank, with what training and scoring look up per word."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int,
                 n_in: int = IN_WORDS, n_out: int = OUT_WORDS):
        self.words, self.counts, self.n, self.v = words, counts, n, v
        self.n_in, self.n_out = min(n_in, len(words)), max(1, min(n_out, len(words)))
        self.other = float(n - counts[:self.n_out].sum())
        self.ids = self.n_in + BUCKETS + 1  # words, buckets, the start of a text
        self.tables: Lookup | None = None

    def model(self) -> LogBilinear:
        counts = np.zeros(self.n_out)
        counts[:len(self.counts[:self.n_out])] = self.counts[:self.n_out]
        return LogBilinear(self.ids, counts, self.other)

    def lookup(self) -> Lookup:
        """A worker's tables, built once for all of its tasks (the broadcast object lives as long)."""
        if self.tables is None:
            self.tables = Lookup(self)
        return self.tables


def _bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


class Lookup:
    """A worker's tables: rank, context id and log count of a word."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.rank = {w: k for k, w in enumerate(v.words)}
        # one place more, which -1 reads: words outside the head
        self.context = np.array([*(k if k < v.n_in else v.n_in + _bucket(w) for k, w in enumerate(v.words)), -1], np.int64)
        self.target = np.minimum(np.append(np.arange(len(v.words)), v.n_out), v.n_out)
        self.log_count = np.append(np.log10(v.counts + 1.0), 0.0)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))

    def pairs(self, words: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context ids ``(n, CONTEXT)`` and output ids of a text's tokens."""
        ids = self.context[ranks]
        unknown = np.flatnonzero(ranks < 0)
        if len(unknown):
            ids[unknown] = [self.v.n_in + _bucket(words[k]) for k in unknown.tolist()]
        x = np.empty((len(words), CONTEXT), np.int64)
        for j in range(CONTEXT):
            x[:j + 1, j], x[j + 1:, j] = self.v.ids - 1, ids[:max(len(ids) - 1 - j, 0)]
        return x, self.target[ranks]


def _tokens(text: bytes) -> list[bytes]:
    return [*space_words(text), END.encode()]


def vocabulary(counts: DataFrame, head: int = HEAD_WORDS) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    got = sorted(((-r["n"], r["piece"].encode()) for r in frequent_pieces(counts, head).collect()))
    return Vocabulary([w for _, w in got], np.array([-n for n, _ in got], np.int64), total[0], total[1])


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The packed parameters after NCE training on all of ``docs``."""
    sc = docs.sparkSession.sparkContext
    model = vocab.model()
    words = sc.broadcast(vocab)
    for r in range(rounds):
        start = sc.broadcast(pack(model.params))

        def run(batches, start=start, r=r):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            v = words.value
            look, own = v.lookup(), v.model()
            own.params = unpack(start.value, own.shapes)
            steps, trainer = 0, own.trainer(1000 * r + part)
            xs, ys, held, seen = [], [], 0, 0

            def learn(last: bool):
                nonlocal xs, ys, held, steps
                if not held:
                    return
                x, y, at = np.concatenate(xs), np.concatenate(ys), 0
                while True:
                    size = min(BATCH << (steps // GROW_STEPS), BATCH_MOST)
                    if at == len(y) or len(y) - at < size and not last:
                        break
                    trainer.step(x[at:at + size], y[at:at + size])
                    at, steps = min(at + size, len(y)), steps + 1
                xs, ys, held = [x[at:]], [y[at:]], len(y) - at

            for batch in batches:
                for text in texts_of(batch):
                    tokens = _tokens(text)
                    x, y = look.pairs(tokens, look.ranks(tokens))
                    xs.append(x)
                    ys.append(y)
                    held, seen = held + len(y), seen + len(y)
                    if held >= 4 * BATCH_MOST:
                        learn(False)
            learn(True)
            if seen:
                flat = pack(trainer.params) * np.float64(seen)
                for k, at in enumerate(range(0, len(flat), _BLOCK)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([float(seen)]),
                         pa.array([flat[at:at + _BLOCK].tobytes()], pa.binary())], ["block", "part", "seen", "sums"])

        mine = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text")
        sums = stored(arrow_map(mine, run, "block int, part int, seen double, sums binary"), "model-parts")
        flat = _average(sums)
        if flat is not None:
            model.params = unpack(flat, model.shapes)
    return pack(model.params)


def _average(sums: DataFrame) -> np.ndarray | None:
    """Weighted mean of the tasks' parameters, AVERAGED tasks of one block at a time."""
    def add(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(b, np.float64) for b in table["sums"].to_pylist()]
        return pa.table({"block": table["block"][:1], "part": table["part"][:1].cast(pa.int32()),
                         "seen": pa.array([sum(table["seen"].to_pylist())]),
                         "sums": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})

    last = sums.agg(F.max("part")).first()[0]
    if last is None:
        return None
    while last > 0:
        sums = sums.select("block", F.floor(F.col("part") / AVERAGED).cast("int").alias("part"), "seen", "sums")
        sums = stored(sums.groupBy("block", "part").applyInArrow(
            add, "block int, part int, seen double, sums binary"), "model-sums")
        last //= AVERAGED
    got = sums.orderBy("block").collect()  # one row per block: the size of the model
    return np.concatenate([np.frombuffer(r["sums"], np.float64) / r["seen"] for r in got]).astype(np.float32)


def scores(docs: DataFrame, training, rounds: int = ROUNDS, head: int = HEAD_WORDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``; ``training`` is a condition on ``docs``."""
    spark = docs.sparkSession
    learnt = docs.where(training)
    counts = stored(word_counts(learnt), "word-counts")
    vocab = vocabulary(counts, head)
    params = train(learnt, vocab, rounds)
    words, flat = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(params)
    names = ["_row", "doc_id", "n_tokens", "n_head", "log_head", "log_other", "n_other", "log_model", "tail"]

    def run(batches):
        v = words.value
        look, model = v.lookup(), v.model()
        model.params = unpack(flat.value, model.shapes)
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in names[2:]}
            tails = PieceLists()
            xs, ys, held = [], [], 0

            def settle():
                nonlocal xs, ys, held
                if held:
                    lp = model.log_probs(np.concatenate(xs), np.concatenate(ys)) / np.log(10)
                    starts = np.cumsum([0] + [len(y) for y in ys[:-1]])
                    cols["log_model"] += np.add.reduceat(lp, starts).tolist()
                xs, ys, held = [], [], 0

            for text in texts_of(batch):
                tokens = _tokens(text)
                ranks = look.ranks(tokens)
                logs, head = look.log_count[ranks], ranks >= 0
                x, y = look.pairs(tokens, ranks)
                cols["n_tokens"].append(len(tokens))
                cols["n_head"].append(int(np.count_nonzero(head)))
                cols["log_head"].append(float(logs.sum()))
                other = y == v.n_out
                cols["log_other"].append(float(logs[other].sum()))
                cols["n_other"].append(int(np.count_nonzero(other)))
                tails.add(Counter(compress(tokens, (~head).tolist())))
                total = 0.0
                while len(y) > SCORE_TOKENS:  # very long texts in pieces
                    total += model.log_probs(x[:SCORE_TOKENS], y[:SCORE_TOKENS]).sum() / np.log(10)
                    x, y = x[SCORE_TOKENS:], y[SCORE_TOKENS:]
                if total:
                    settle()
                xs.append(x)
                ys.append(y)
                held += len(y)
                if total or held >= SCORE_TOKENS:
                    settle()
                    cols["log_model"][-1] += total
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols["n_tokens"], pa.int64()),
                 pa.array(cols["n_head"], pa.int64()), pa.array(cols["log_head"], pa.float64()),
                 pa.array(cols["log_other"], pa.float64()), pa.array(cols["n_other"], pa.int64()),
                 pa.array(cols["log_model"], pa.float64()), tails.array(pa.binary())], names)

    rows = with_row(docs.select("doc_id", "text")).select("_row", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = stored(arrow_map(
        rows, run, f"_row bigint, doc_id {kind}, n_tokens bigint, n_head bigint, log_head double, log_other double, "
                   "n_other bigint, log_model double, tail array<struct<piece:binary,m:int>>"), "score-parts")
    tail = parts.select("_row", F.explode("tail").alias("t")).select(
        "_row", F.col("t.piece").cast("string").alias("piece"), F.col("t.m").alias("m"))
    sums = tail.join(counts, "piece").groupBy("_row").agg(
        F.sum("m").alias("known"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("logs"))
    known, logs = F.coalesce("known", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    z_base = float(np.log10(vocab.n + vocab.v + 1))
    z_other = float(np.log10(vocab.other + max(vocab.v - min(vocab.n_out, len(vocab.words)), 0) + 1))
    return parts.drop("tail").join(sums, "_row", "left").select(
        "doc_id", "n_tokens", (F.col("n_head") + known).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("log_head") + logs - F.col("n_tokens") * z_base).alias("base_score"),
        (F.col("log_model") + F.col("log_other") + logs - F.col("n_other") * z_other).alias("score"))
