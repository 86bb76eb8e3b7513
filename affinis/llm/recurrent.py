"""A gated recurrent language model over words, in NumPy.

Tokens are the `head` of the vocabulary (the end of a text among them), each on its own, and the tail by classes of
a word's form. The output softmax is factored by class: P(token) = P(class | state) P(token | class, state).
Head classes hold tokens of like frequency and have a softmax of their own; within a tail class a word has
its share of the class's counts, whatever the state. Weights start at the counts, so an untrained model is the
smoothed unigram model.

One step, with x the row of the token before (the end, at a text's start) and h the state (zero at a text's start):
z, r = sigmoid(x_zr + h U_zr), n = tanh(x_n + r (h U_n + b)), h' = (1 - z) n + z h. The state h' predicts the token.
"""

from __future__ import annotations

import numpy as np

HIDDEN, WINDOW, LANES = 16, 32, 512
RATE, RATE_INNER = 0.05, 0.02
#: Words of the tail by bytes of their form: up to 4, 7, 10 or more, with or without other than ASCII.
TAIL_CLASSES = 8
#: Lanes and steps that a text is scored in; states are carried from window to window.
SCORE_LANES, SCORE_WINDOW = 1024, 64


class Shape:
    """Counts by head token (in falling order, `end` among them), its classes, and the masses of the tail's classes."""

    def __init__(self, counts: np.ndarray, end: int, tail_mass: np.ndarray, classes: int):
        self.counts, self.end, self.tail_mass = counts.astype(np.float64), end, tail_mass.astype(np.float64)
        root = np.sqrt(self.counts + 1)
        at = np.floor((np.cumsum(root) - root) / root.sum() * classes)
        self.cls = np.unique(at, return_inverse=True)[1]
        self.edges = np.r_[np.flatnonzero(np.r_[True, self.cls[1:] != self.cls[:-1]]), len(counts)]
        self.head, self.head_classes = len(counts), len(self.edges) - 1
        self.classes = self.head_classes + len(tail_mass)

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        """tokens: head ids, then head + tail class."""
        table = np.r_[self.cls, self.head_classes + np.arange(len(self.tail_mass))]
        return table[tokens]


def start(shape: Shape, hidden: int = HIDDEN, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    mass = np.r_[np.bincount(shape.cls, weights=shape.counts + 1), shape.tail_mass]
    p = {
        "E": rng.normal(0, 0.3, (shape.head + len(shape.tail_mass), 3 * hidden)),
        "U": rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)),
        "b": np.zeros(hidden),
        "Wc": np.zeros((hidden, shape.classes)),
        "bc": np.log(mass / mass.sum()),
        "Wo": np.zeros((shape.head, hidden)),
        "bo": np.log((shape.counts + 1) / mass[shape.cls]),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    k = h.shape[1]
    g = h @ p["U"]
    zr = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    gn = g[:, 2 * k :] + p["b"]
    n = np.tanh(x[:, 2 * k :] + r * gn)
    return n + z * (h - n), z, r, n, gn


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s -= s.max(axis=1, keepdims=True)
    s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
    return s


def outputs(p: dict[str, np.ndarray], shape: Shape, hs: np.ndarray, tokens: np.ndarray, gradients: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each row's token given its state (of a tail token: of its class). With gradients (filled), also d/dh."""
    cls, rows = shape.class_of(tokens), np.arange(len(tokens))
    s = _log_softmax(hs @ p["Wc"] + p["bc"])
    logp = s[rows, cls]
    dh = None
    if gradients is not None:
        d = np.exp(s, out=s)
        d[rows, cls] -= 1
        gradients["Wc"], gradients["bc"] = hs.T @ d, d.sum(axis=0)
        gradients["Wo"], gradients["bo"] = np.zeros_like(p["Wo"]), np.zeros_like(p["bo"])
        dh = d @ p["Wc"].T
    order = np.argsort(cls.astype(np.int16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(shape.head_classes + 1))
    for k, (lo, hi) in enumerate(zip(shape.edges[:-1], shape.edges[1:], strict=True)):
        own = order[bounds[k] : bounds[k + 1]]
        if not len(own) or hi - lo == 1:
            continue
        h, at = hs[own], (np.arange(len(own)), tokens[own] - lo)
        s = _log_softmax(h @ p["Wo"][lo:hi].T + p["bo"][lo:hi])
        logp[own] += s[at]
        if gradients is not None:
            d = np.exp(s, out=s)
            d[at] -= 1
            gradients["Wo"][lo:hi], gradients["bo"][lo:hi] = d.T @ h, d.sum(axis=0)
            dh[own] += d @ p["Wo"][lo:hi]
    return logp, dh


def score(p: dict[str, np.ndarray], shape: Shape, tokens: np.ndarray, lengths: np.ndarray, lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """Natural log-probability of each text; tokens: all texts one after another, each with its end."""
    first, out = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
    by_length = np.argsort(-lengths, kind="stable")
    hidden = p["U"].shape[0]
    for g in range(0, len(by_length), lanes):
        own = by_length[g : g + lanes]
        n, begin = lengths[own], first[own]
        h, before = np.zeros((len(own), hidden), np.float32), np.full(len(own), shape.end)
        for t0 in range(0, int(n[0]) if len(n) else 0, window):
            live = int(np.searchsorted(-n, -t0, side="left"))  # lanes whose text goes on at t0: the first ones
            steps = min(window, int(n[0]) - t0)
            inside = (t0 + np.arange(steps))[:, None] < n[:live]
            seen = tokens[np.minimum(begin[:live] + (t0 + np.arange(steps))[:, None], len(tokens) - 1)]
            given = np.concatenate([before[None, :live], seen[:-1]])
            x, hs = p["E"][given], np.zeros((steps, live, hidden), np.float32)
            active = inside.sum(axis=1)
            for t in range(steps):
                a = int(active[t])
                h[:a] = _step(p, x[t, :a], h[:a])[0]
                hs[t, :a] = h[:a]
            before[:live] = seen[-1]
            logp = outputs(p, shape, hs[inside], seen[inside])[0]
            out[own[:live]] += np.bincount(np.nonzero(inside)[1], weights=logp, minlength=live)
    return out


class Trainer:
    """Truncated backpropagation with per-weight step sizes (Adagrad); states are carried, gradients end at the window."""

    def __init__(self, p: dict[str, np.ndarray], shape: Shape, window: int = WINDOW, lanes: int = LANES):
        self.p, self.shape, self.window, self.lanes = p, shape, window, lanes
        self.seen = {k: np.zeros_like(v) for k, v in p.items()}

    def gradients(self, given: np.ndarray, aim: np.ndarray, counted: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float, np.ndarray]:
        """(summed gradients, last state, log-likelihood, rows of E met) of a window of steps x lanes."""
        p, k = self.p, h.shape[1]
        steps, lanes = given.shape
        x, keep = p["E"][given], (given != self.shape.end).astype(np.float32)[:, :, None]
        before, hs, z, r, n, gn = (np.empty((steps, lanes, k), np.float32) for _ in range(6))
        for t in range(steps):
            before[t] = h * keep[t]
            hs[t], z[t], r[t], n[t], gn[t] = _step(p, x[t], before[t])
            h = hs[t]
        g: dict[str, np.ndarray] = {}
        logp, inner = outputs(p, self.shape, hs[counted], aim[counted], g)
        dhs = np.zeros_like(hs)
        dhs[counted] = inner
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), gn * r * (1 - r)
        dx, dg, dh = np.empty_like(x), np.empty_like(x), np.zeros_like(h)
        back = p["U"].T.copy()
        for t in range(steps - 1, -1, -1):
            d = dhs[t] + dh
            dn = d * to_n[t]
            dx[t, :, :k] = d * to_z[t]
            dx[t, :, k : 2 * k] = dn * to_r[t]
            dx[t, :, 2 * k :] = dn
            dg[t, :, : 2 * k] = dx[t, :, : 2 * k]
            dg[t, :, 2 * k :] = dn * r[t]
            dh = (d * z[t] + dg[t] @ back) * keep[t]
        dg = dg.reshape(-1, 3 * k)
        g["U"], g["b"] = before.reshape(-1, k).T @ dg, dg[:, 2 * k :].sum(axis=0)
        order = np.argsort(given.ravel().astype(np.int16 if len(p["E"]) < 1 << 15 else np.int64), kind="stable")
        met, starts = np.unique(given.ravel()[order], return_index=True)
        g["E"] = np.add.reduceat(dx.reshape(-1, 3 * k)[order], starts, axis=0)
        return g, h, float(logp.sum()), met

    def window_step(self, given: np.ndarray, aim: np.ndarray, counted: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        g, h, total, met = self.gradients(given, aim, counted, h)
        scale = np.float32(1 / max(counted.sum(), 1))
        for name, d in g.items():
            d *= scale
            rate = RATE_INNER if name in ("U", "b") else RATE
            if name == "E":
                self.seen["E"][met] += d * d
                self.p["E"][met] -= rate * d / (np.sqrt(self.seen["E"][met]) + 1e-10)
            else:
                self.seen[name] += d * d
                self.p[name] -= rate * d / (np.sqrt(self.seen[name]) + 1e-10)
        return h, total

    def learn(self, tokens: np.ndarray) -> float:
        """One pass over texts laid end to end, cut into lanes; returns the log-likelihood met on the way."""
        if not len(tokens):
            return 0.0
        lanes = int(min(self.lanes, max(1, len(tokens) // (4 * self.window))))
        length = -(-len(tokens) // lanes)
        aim = np.full(lanes * length, self.shape.end)
        aim[: len(tokens)] = tokens
        counted = (np.arange(lanes * length) < len(tokens)).reshape(lanes, length).T
        given = np.r_[self.shape.end, aim[:-1]].reshape(lanes, length).T
        aim = aim.reshape(lanes, length).T
        h, total = np.zeros((lanes, self.p["U"].shape[0]), np.float32), 0.0
        for t in range(0, length, self.window):
            h, got = self.window_step(given[t : t + self.window], aim[t : t + self.window], counted[t : t + self.window], h)
            total += got
        return total
