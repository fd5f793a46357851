"""Mixing to target weights by soft domain membership.

A naive Bayes classifier over hashed words is fitted on labelled rows (at most
``FIT_ROWS``, a documented bound; chosen by a hash of the id) and gives every
document posteriors ``p`` over the domains; long texts are tempered by the
square root of their length, so membership stays soft.  Document rates ``r``
in ``[0, max_rate]`` minimise

    f(r) = 1/2 sum_d (sum_i r_i t_i p_id - T_d)^2 / (W N_d)

(``t``: tokens, ``W``: their sum, ``T``: target tokens per domain, ``N``: the
domains' natural tokens) by projected gradient descent with momentum from the
mean rate, so small domains weigh as much as large ones.  A round is one pass:
tasks replay the earlier rounds' gradients (one small vector each) to have
their rows' current rates, and send back a few sums per domain.  So no state is
stored per document, a lost executor costs nothing but its rows, and the final
rates are a function of the text that a map-only pass computes anew.

Rounds end when every domain is within ``TOLERANCE`` of its own target, or when
the targets are proven out of reach: ``f`` is convex, so no rates bring it below
``f(r) - gap`` with ``gap = max_s grad f(r) . (r - s)`` over all rates ``s``.
If the gap is below ``GAP`` of ``f``, the best rates miss too and these are
nearly as good.  What is still missing is in ``Mixer.miss`` and in the log.

Without given weights the targets are the natural shares to the power
``TEMPER``; without a given budget it is the largest that rates of ``max_rate``
can reach.  ``copies`` realises a rate: its whole part plus one more where a
hash of the id falls below its fraction.

Defined results: NULL texts are empty (posterior = prior); a NULL domain is no
label; without labelled rows, or without tokens, every rate is ``max_rate`` or
1, whichever is less; a weight for a domain that no labelled row has is left
out; rows that repeat an id share its draw; other columns pass through ``mix``.
"""

from __future__ import annotations

import logging
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sardonyx.llm.common import arrow_map, fresh, hash_share, space_words, stored, texts_of

FIT_ROWS = 30_000
BUCKETS = 8192
MOST_DOMAINS = 256
SMOOTH = 0.1
TEMPER = 0.7
ROUNDS = 400
#: Rounds end when every domain's total is this near its own target, as a share of that target.
TOLERANCE = 0.005
#: Targets are out of reach when no rates lower f by more than this share of it.
GAP = 0.05

_LOG = logging.getLogger(__name__)


def _hashed(text: bytes) -> np.ndarray:
    words = space_words(text)
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS


@dataclass
class Mixer:
    """Classifier and solution; what a task needs to give a text its rate."""
    domains: list[str]
    log_prior: np.ndarray
    log_word: np.ndarray        # (BUCKETS, domains)
    max_rate: float = 1.0
    start: float = 1.0
    #: Each round's gradient over the domains, and the momentum after its step.
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)
    #: Each domain's total over its target, less 1 (without a target: over its total at the mean rate).
    miss: dict[str, float] = field(default_factory=dict)
    ended: str = "no targets"

    def memberships(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers and posteriors of some texts."""
        n, logs = [], []
        for text in texts:
            h = _hashed(text)
            n.append(len(h))
            evidence = self.log_word[h].sum(axis=0) / max(np.sqrt(len(h)), 1.0)
            logs.append(self.log_prior + evidence)
        p = np.array(logs).reshape(len(n), len(self.domains))
        if p.size:
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
        return np.array(n, np.int64), p

    def rates(self, p: np.ndarray) -> np.ndarray:
        """The rates after all rounds so far."""
        return self.points(p)[0]

    def points(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates after all rounds so far, and where the next round's gradient is taken."""
        r = ahead = np.full(len(p), min(self.start, self.max_rate))
        for g, momentum in self.steps:
            new = np.clip(ahead - p @ g, 0.0, self.max_rate)
            r, ahead = new, new + momentum * (new - r)
        return r, ahead


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str, most: int = FIT_ROWS) -> Mixer:
    """Count hashed words per domain over labelled rows; ``labels`` names them by ``doc_id``."""
    known = labels.select("doc_id").where("doc_id is not null").distinct()
    total = known.count()
    if total > most:
        known = known.where(hash_share("doc_id", most, total)).limit(most)
    rows = (docs.select("doc_id", "text", F.col(domain).cast("string").alias("domain"))
            .join(F.broadcast(known), "doc_id").where("domain is not null").select("text", "domain"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, d in zip(texts_of(b), b.column(1).to_pylist()):
                own = sums.setdefault(d, np.zeros(BUCKETS + 1, np.int64))  # the last: documents
                own[:BUCKETS] += np.bincount(_hashed(text), minlength=BUCKETS)
                own[BUCKETS] += 1
        for d, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at)), pa.array(at), pa.array(own[at])],
                                             ["domain", "bucket", "n"])

    counts = stored(arrow_map(rows, count, "domain string, bucket bigint, n bigint")
                    .groupBy("domain", "bucket").agg(F.sum("n").alias("n")), "domain-words")
    domains = [r["domain"] for r in counts.select("domain").distinct().orderBy("domain").limit(MOST_DOMAINS + 1).collect()]
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"{domain} has more than {MOST_DOMAINS} values")
    got = counts.toArrow()  # at most domains x (BUCKETS + 1) rows
    table = np.zeros((BUCKETS + 1, len(domains)))
    if domains:
        at = {d: k for k, d in enumerate(domains)}
        table[got["bucket"].to_numpy(), [at[d] for d in got["domain"].to_pylist()]] = got["n"].to_numpy()
    words, number = table[:BUCKETS] + SMOOTH, table[BUCKETS]
    return Mixer(domains, np.log((number + 1) / (number.sum() + max(len(domains), 1))),
                 np.log(words / words.sum(axis=0, keepdims=True)))


def _members(docs: DataFrame, mixer: Mixer) -> DataFrame:
    """``t, p`` of every document, without its text."""
    box = docs.sparkSession.sparkContext.broadcast(mixer)

    def run(batches):
        for b in batches:
            t, p = box.value.memberships(texts_of(b))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(t), flat], ["t", "p"])

    return arrow_map(docs.select("text"), run, "t bigint, p array<double>")


def _totals(members: DataFrame, mixer: Mixer, gradient: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Expected tokens per domain at the current rates and at the point ahead, the sum of tokens, and
    the least that ``gradient . totals`` can be."""
    k = len(mixer.domains)
    box = members.sparkSession.sparkContext.broadcast((mixer, np.zeros(k) if gradient is None else gradient))

    def run(batches):
        m, g = box.value
        sums = np.zeros(2 * k + 2)
        for b in batches:
            t = b.column(0).to_numpy().astype(float)
            p = b.column(1).flatten().to_numpy().reshape(len(t), k)
            r, ahead = m.points(p)
            sums[:k] += (t * r) @ p
            sums[k:2 * k] += (t * ahead) @ p
            sums[2 * k] += t.sum()
            sums[2 * k + 1] += m.max_rate * (t @ np.minimum(p @ g, 0.0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * k + 2)), pa.array(sums)], ["d", "n"])

    out = np.zeros(2 * k + 2)
    for r in arrow_map(members, run, "d bigint, n double").groupBy("d").agg(F.sum("n").alias("n")).collect():
        out[r["d"]] = r["n"]
    return out[:k], out[k:2 * k], out[2 * k], out[2 * k + 1]


def solve(docs: DataFrame, labels: DataFrame, domain: str, weights: dict[str, float] | None = None,
          budget: float | None = None, max_rate: float = 1.0, rounds: int = ROUNDS) -> Mixer:
    """Fit the classifier and the rates."""
    mixer = fit_classifier(docs, labels, domain)
    mixer.max_rate = max_rate
    if not mixer.domains:
        return mixer
    members = stored(_members(docs, mixer), "memberships")
    natural, _, total, _ = _totals(members, Mixer(mixer.domains, mixer.log_prior, mixer.log_word[:0]))
    if total == 0:
        return mixer
    w = (natural / total) ** TEMPER if weights is None else np.array([weights.get(d, 0.0) for d in mixer.domains])
    if w.sum() <= 0:
        raise ValueError("no target weight is positive")
    w = w / w.sum()
    if budget is None:
        budget = float(min(max_rate * natural[w > 0] / w[w > 0]))
    mixer.start = budget / total
    target, share = budget * w, np.maximum(natural, 1e-9)
    own = np.where(target > 0, target, share * mixer.start)
    last_f, last_slope, slope, k = np.inf, 0.0, None, 0
    for done in range(rounds + 1):
        at, ahead, _, least = _totals(members, mixer, slope)
        off = at - target
        mixer.miss = dict(zip(mixer.domains, (off / own).tolist()))
        mixer.ended = f"stopped after {done} rounds"
        f = float((off * off / share).sum() / 2)
        if np.abs(off / own).max() <= TOLERANCE:
            mixer.ended = "met"
            break
        # the pass before this one's rates: its slope is known now, and so is what any rates can gain on it
        if slope is not None and last_slope - least <= GAP * last_f:
            mixer.ended = "out of reach"
            break
        if done == rounds:
            break
        if f > last_f:  # the momentum led too far: stop and go on from here
            k, ahead = 0, at
            g, momentum = mixer.steps[-1]
            mixer.steps[-1] = (g, 0.0)
        mixer.steps.append(((ahead - target) / share, (k + 1) / (k + 4)))
        slope, k = off / share, k + 1
        last_f, last_slope = f, float(slope @ at)
    _LOG.log(logging.INFO if mixer.ended == "met" else logging.WARNING, "mixing targets %s; miss of each domain's target: %s",
             mixer.ended, {d: round(x, 5) for d, x in mixer.miss.items()})
    return mixer


def rated(docs: DataFrame, mixer: Mixer, names: tuple[str, str, str, str]) -> DataFrame:
    """All columns of ``docs`` and ``names``: tokens, likeliest domain, its posterior, rate."""
    box, at = docs.sparkSession.sparkContext.broadcast(mixer), docs.columns.index("text")

    def run(batches):
        m = box.value
        for b in batches:
            t, p = m.memberships(texts_of(b, b.schema.names[at]))
            best = p.argmax(axis=1) if m.domains else np.zeros(len(t), int)
            name = [m.domains[k] for k in best] if m.domains else [None] * len(t)
            top = p[np.arange(len(t)), best] if m.domains else np.zeros(len(t))
            rate = m.rates(p)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(t), pa.array(name, pa.string()), pa.array(top), pa.array(rate)],
                [*b.schema.names, *names])

    schema = T.StructType(list(docs.schema.fields))
    for n, kind in zip(names, (T.LongType(), T.StringType(), T.DoubleType(), T.DoubleType())):
        schema = schema.add(n, kind)
    return arrow_map(docs, run, schema)


def copies_of(rate: str):
    """A rate as a number of copies, drawn by a hash of the id."""
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(F.col(rate))
    return (whole + (u < F.col(rate) - whole).cast("int")).cast("int")


def plan(docs: DataFrame, labels: DataFrame, domain: str = "lang", **targets) -> DataFrame:
    """``doc_id, n_tokens, domain, posterior, rate, copies`` of every document."""
    mixer = solve(docs, labels, domain, **targets)
    names = ("n_tokens", "domain", "posterior", "rate")
    return rated(docs.select("doc_id", "text"), mixer, names).select("doc_id", *names, copies_of("rate").alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", **targets) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says."""
    mixer = solve(docs, labels, domain, **targets)
    names = tuple(fresh(docs, n) for n in ("_tokens", "_domain", "_posterior", "_rate"))
    out = rated(docs, mixer, names)
    if mixer.max_rate <= 1:
        out = out.where(copies_of(names[3]) > 0)
    else:
        again = fresh(docs, "_copy")
        out = out.where(copies_of(names[3]) > 0).withColumn(
            again, F.explode(F.sequence(F.lit(1), copies_of(names[3])))).drop(again)
    return out.drop(*names)
