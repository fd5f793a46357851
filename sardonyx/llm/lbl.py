"""A log-bilinear language model in numpy, trained by noise-contrastive estimation.

The vector of a context is ``q = sum_j C_j E[w_-j]`` over the previous words.
Output words are cut into classes by frequency rank, and a word's probability
is ``P(class | q) * P(word | class, q)``, both softmaxes of bilinear scores
``q . r + b``; words outside the output vocabulary share one class of their
own.  Both levels are trained by NCE against the training unigrams (noise
drawn once per minibatch and shared by its rows, so every step is a matrix
product) and normalised exactly when texts are scored.
"""

from __future__ import annotations

import numpy as np

WIDTH, CONTEXT = 24, 2
CLASS_WORDS = 64
#: Noise draws per minibatch and level, and the assumed noise rows per data row.
DRAWS, NOISE = 48, 8.0
RATE = 0.05


def sizes(n_in: int, n_out: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the parameters, for ``n_in`` context ids and ``n_out`` output words."""
    classes = -(-n_out // CLASS_WORDS)
    return {"embed": (n_in, WIDTH), "mix": (CONTEXT, WIDTH, WIDTH), "top": (classes + 1, WIDTH),
            "top_bias": (classes + 1,), "out": (classes, CLASS_WORDS, WIDTH), "out_bias": (classes, CLASS_WORDS)}


def pack(params: dict) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)]).astype(np.float32)


def unpack(flat: np.ndarray, shapes: dict) -> dict:
    out, at = {}, 0
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = flat[at:at + n].reshape(shapes[k]).copy()
        at += n
    return out


class LogBilinear:
    """Parameters plus the unigram noise: ``counts`` of the output words by rank, ``other`` of the rest."""

    def __init__(self, n_in: int, counts: np.ndarray, other: float):
        self.n_out, self.classes = len(counts), -(-len(counts) // CLASS_WORDS)
        padded = np.zeros(self.classes * CLASS_WORDS)
        padded[:self.n_out] = counts + 1.0
        grid = padded.reshape(self.classes, CLASS_WORDS)
        top = np.append(grid.sum(axis=1), other + 1.0)
        with np.errstate(divide="ignore"):
            self.top_noise = np.log(top / top.sum()).astype(np.float32)
            self.out_noise = np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)
        self.shapes = sizes(n_in, self.n_out)
        rng = np.random.default_rng(7)
        p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in self.shapes.items()}
        p["mix"] += np.eye(WIDTH, dtype=np.float32) / CONTEXT
        for k in ("top", "out"):
            p[k] *= 0.1
        # biases start at the unigram: without training the model is the unigram model
        p["top_bias"], p["out_bias"] = self.top_noise.copy(), np.maximum(self.out_noise, -30.0)
        self.params, self.mixed = p, None

    def _levels(self, y: np.ndarray):
        """Class of each output id, the rows in the order of their classes, and each class's part of them."""
        cls = np.where(y < self.n_out, y // CLASS_WORDS, self.classes)
        order = np.argsort(cls.astype(np.uint16), kind="stable")  # a radix sort
        ends = np.searchsorted(cls[order], np.arange(self.classes + 1))
        return cls, order, [(c, a, b) for c, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if b > a]

    def contexts(self, x: np.ndarray) -> np.ndarray:
        """Context vectors, from the words' vectors at each place (mixed once for all of the vocabulary)."""
        if self.mixed is None or self.mixed[0] is not self.params:
            self.mixed = self.params, [self.params["embed"] @ self.params["mix"][j] for j in range(CONTEXT)]
        return sum(m.take(x[:, j], axis=0) for j, m in enumerate(self.mixed[1]))

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probabilities; ``x`` (n, CONTEXT) context ids, ``y`` output ids (n_out or more: other)."""
        p, q = self.params, self.contexts(x)
        cls, order, groups = self._levels(y)
        out = _log_softmax_at(q @ p["top"].T, p["top_bias"], cls)
        q, y = q.take(order, axis=0), y.take(order)
        within = np.zeros(len(y))
        for c, a, b in groups:
            s, bias = q[a:b] @ p["out"][c].T, p["out_bias"][c]
            if (c + 1) * CLASS_WORDS > self.n_out:
                s, bias = s[:, :self.n_out - c * CLASS_WORDS], bias[:self.n_out - c * CLASS_WORDS]
            within[a:b] = _log_softmax_at(s, bias, y[a:b] - c * CLASS_WORDS)
        out[order] += within
        return out

    def trainer(self, seed: int) -> Trainer:
        return Trainer(self, seed)


def _log_softmax_at(s: np.ndarray, bias: np.ndarray, y: np.ndarray) -> np.ndarray:
    s += bias
    if s.size and s.max() > 80:  # else nothing overflows and one pass less is needed
        s -= s.max(axis=1, keepdims=True)
    at = s[np.arange(len(y)), y]
    return (at - np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32))).astype(np.float64)


def _blocks(groups: list) -> list[list]:
    """Neighbouring classes of similar numbers of rows, so that filling them up adds few rows."""
    out, most, total = [], 0, 0
    for g in groups:
        n = g[2] - g[1]
        if out and max(most, n) * (len(out[-1]) + 1) <= 1.5 * (total + n) + 64:
            out[-1].append(g)
            most, total = max(most, n), total + n
        else:
            out.append([g])
            most, total = n, n
    return out


class Trainer:
    """Adagrad steps of the NCE loss on a copy of the parameters."""

    def __init__(self, model: LogBilinear, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.params = {k: v.copy() for k, v in model.params.items()}
        self.seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in self.params.items()}
        self.top_noise = self._noise(model.top_noise)
        self.out_noise = [np.stack(x) for x in zip(*map(self._noise, model.out_noise))]

    @staticmethod
    def _noise(logs):
        """Draw shares, and what a score must exceed for data to be likelier than noise."""
        share = np.exp(logs.astype(np.float64))
        return share / share.sum(), (np.maximum(logs, -30.0) + np.log(NOISE)).astype(np.float32)

    def _nce(self, q, r, b, noise, y):
        """Gradients ``dq, dr, db`` of one level for rows ``q`` with targets ``y``."""
        share, shift = noise
        weight = (self.rng.multinomial(DRAWS, share) * (NOISE / DRAWS)).astype(np.float32)
        near = q @ r.T  # in place from here: scores, minus log odds, probability of data
        np.subtract(shift - b, near, out=near)
        np.exp(np.minimum(near, 30, out=near), out=near)
        near += 1
        np.reciprocal(near, out=near)
        flat, at = near.reshape(-1), np.arange(0, near.size, near.shape[1]) + y  # the targets' places
        beyond = flat.take(at) - 1
        g = np.multiply(near, weight, out=near)
        flat[at] += beyond
        return g @ r, g.T @ q, np.ones(len(y), np.float32) @ g

    def _nce_block(self, q, y, groups):
        """``_nce`` of neighbouring classes at once: their rows stand below each other, filled up to the largest."""
        of = [c for c, _, _ in groups]
        size = np.array([b - a for _, a, b in groups])
        real = np.arange(size.max()) < size[:, None]
        place = np.array([a for _, a, _ in groups])[:, None] + np.arange(size.max())
        place[~real] = groups[0][1]
        rows, r = q[place], self.params["out"][of]
        rows[~real] = 0
        share, shift = self.out_noise
        weight = (self.rng.multinomial(DRAWS, share[of]) * (NOISE / DRAWS)).astype(np.float32)
        near = rows @ r.transpose(0, 2, 1)
        np.subtract((shift[of] - self.params["out_bias"][of])[:, None], near, out=near)
        np.exp(np.minimum(near, 30, out=near), out=near)
        near += 1
        np.reciprocal(near, out=near)
        target = np.where(real, y[place] - np.array(of)[:, None] * CLASS_WORDS, 0).ravel()
        flat, at = near.reshape(-1), np.arange(0, near.size, CLASS_WORDS) + target
        beyond = (flat.take(at) - 1) * real.ravel()
        g = np.multiply(near, weight[:, None], out=near)
        flat[at] += beyond
        return (g @ r)[real], g.transpose(0, 2, 1) @ rows, (real[:, None].astype(np.float32) @ g)[:, 0]

    def _step(self, key, grad, at=...):
        seen = self.seen[key][at] + grad * grad
        self.seen[key][at] = seen
        self.params[key][at] -= RATE * grad / np.sqrt(seen)

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        m, p, n = self.model, self.params, np.float32(len(y))
        e = [p["embed"].take(x[:, j], axis=0) for j in range(CONTEXT)]
        q = sum(e[j] @ p["mix"][j] for j in range(CONTEXT))
        cls, order, groups = m._levels(y)
        dq, dr, db = self._nce(q, p["top"], p["top_bias"], self.top_noise, cls)
        self._step("top", dr / n)
        self._step("top_bias", db / n)
        if groups:
            qs, ys, dqs = q.take(order, axis=0), y.take(order), np.zeros_like(q)
            of, drs, dbs = [c for c, _, _ in groups], [], []
            for some in _blocks(groups):
                at, end = some[0][1], some[-1][2]
                dqs[at:end], dr, db = self._nce_block(qs, ys, some)
                drs.append(dr)
                dbs.append(db)
            dq[order] += dqs
            self._step("out", np.concatenate(drs) / n, of)
            self._step("out_bias", np.concatenate(dbs) / n, of)
        mix = np.stack([e[j].T @ dq for j in range(CONTEXT)])
        de = np.concatenate([dq @ p["mix"][j].T for j in range(CONTEXT)])
        self._step("mix", mix / n)
        ids = x.T.ravel().astype(np.uint16 if m.shapes["embed"][0] <= 1 << 16 else np.int64)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
        self._step("embed", np.add.reduceat(de[order], first, axis=0) / n, ids[order][first])
