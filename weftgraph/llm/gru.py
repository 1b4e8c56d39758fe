"""A gated recurrent language model in numpy, with class-factored softmax and truncated backpropagation."""

from __future__ import annotations

import numpy as np

HIDDEN, EMBED = 32, 16
NAMES = ("emb", "wx", "bx", "uh", "wc", "bc", "wo", "bo")


class Layout:
    """Words, classes and starting probabilities.

    Inputs are the ``n_words`` frequent words by place, then ``n_rare`` spelling classes of
    all other words. Output classes are runs of frequent words with equal shares of the
    square roots of their counts, then each spelling class; a word of a spelling class has
    its share of the class's smoothed counts, so the whole is a distribution over the same
    words, unseen ones included, as the smoothed counts.
    """

    def __init__(self, counts: np.ndarray, rare: np.ndarray, n_classes: int = 64):
        self.n_words, self.n_rare = len(counts), len(rare)
        share = np.cumsum(np.sqrt(counts))
        of = np.minimum((n_classes * (share - np.sqrt(counts) / 2) / share[-1]).astype(int), n_classes - 1)
        _, of = np.unique(of, return_inverse=True)
        self.class_of = np.concatenate([of, of.max() + 1 + np.arange(self.n_rare)])
        self.first = np.searchsorted(of, np.arange(of.max() + 2))
        self.n_open = of.max() + 1
        self.width = np.diff(self.first)
        self.place_of = np.arange(self.n_words) - self.first[of]
        self._bounds = list(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True))
        self.n_classes = self.n_open + self.n_rare
        self.counts, self.rare = counts, rare

    def runs(self, ends: list[int]):
        """Begin and end of each class's rows and words, of the classes of frequent words that have rows; ``ends`` as of _by_class."""
        for i, j, (lo, hi) in zip(ends, ends[1:], self._bounds):
            if i < j:
                yield i, j, lo, hi

    def start(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(4)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        mass = np.concatenate([np.add.reduceat(self.counts, self.first[:-1]), self.rare])
        within = self.counts / mass[self.class_of[: self.n_words]]
        return {
            "emb": (rng.standard_normal((self.n_words + self.n_rare, EMBED)) * 0.3).astype(np.float32),
            "wx": normal(EMBED, 3 * HIDDEN),
            "bx": np.zeros(3 * HIDDEN, np.float32),
            "uh": normal(HIDDEN, 3 * HIDDEN),
            "wc": np.zeros((HIDDEN, self.n_classes), np.float32),
            "bc": np.log(mass / mass.sum()).astype(np.float32),
            "wo": np.zeros((self.n_words, HIDDEN), np.float32),
            "bo": np.log(within).astype(np.float32),
        }


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in NAMES])


def unflat(v: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for n in NAMES:
        out[n] = v[at : at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out


def _step(x, h, uh, made=None, gate=None, c=None, out=None):
    """One step: x has the inputs' part of the gates. Returns the new state; what backpropagation needs is left in the arrays that are given."""
    n = HIDDEN
    made = np.matmul(h, uh, out=made)
    gate = np.add(x[:, : 2 * n], made[:, : 2 * n], out=gate)
    gate *= 0.5  # the logistic function, by tanh
    np.tanh(gate, out=gate)
    gate += 1
    gate *= 0.5
    c = np.multiply(gate[:, :n], made[:, 2 * n :], out=c)
    c += x[:, 2 * n :]
    np.tanh(c, out=c)
    out = np.subtract(h, c, out=out)
    out *= gate[:, n:]
    out += c
    return out


def _by_class(lay: Layout, target: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Rows in the order of their targets' classes, and where the rows of each class of frequent words end."""
    cls = lay.class_of[target].astype(np.int16 if lay.n_classes < 1 << 15 else np.int64)
    return np.argsort(cls, kind="stable"), [0, *np.cumsum(np.bincount(cls, minlength=lay.n_open)[: lay.n_open]).tolist()]


def log_probs(p: dict, lay: Layout, h: np.ndarray, target: np.ndarray, block: int = 2048) -> np.ndarray:
    """Natural log of each target's probability: its class, and its word within the class if that is a frequent one."""
    out = np.empty(len(h))
    for a in range(0, len(h), block):  # rows at a time, so that what is made of them stays in the cache
        out[a : a + block] = _block_log_probs(p, lay, h[a : a + block], target[a : a + block])
    return out


def _log_share(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at its place ``at``; ``logit`` is used up."""
    logit -= np.maximum.reduce(logit, axis=1, keepdims=True)
    own = logit[np.arange(len(at)), at]
    np.exp(logit, out=logit)
    return own - np.log(np.add.reduce(logit, axis=1))


def _block_log_probs(p: dict, lay: Layout, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    logit = h @ p["wc"]
    logit += p["bc"]
    out = _log_share(logit, lay.class_of[target]).astype(float)
    order, ends = _by_class(lay, target)
    order = order[: ends[-1]]
    logit, begin, width = _word_logits(p["wo"], p["bo"], lay, h[order], ends)
    logit -= np.repeat(np.maximum.reduceat(logit, begin), width)
    own = logit[begin + lay.place_of[target[order]]]
    np.exp(logit, out=logit)
    out[order] += own - np.log(np.add.reduceat(logit, begin))
    return out


def _word_logits(wo: np.ndarray, bo: np.ndarray, lay: Layout, h: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all words of each row's class, one row behind the other; where each row's begin, and how many there are. Rows lie by class, see _by_class."""
    width = np.repeat(lay.width, np.diff(ends))
    begin = np.concatenate([[0], np.cumsum(width)])
    logit, begin, at = np.empty(begin[-1], np.float32), begin[:-1], 0
    for i, j, lo, hi in lay.runs(ends):
        to = at + (j - i) * (hi - lo)
        part = logit[at:to].reshape(j - i, hi - lo)
        np.matmul(h[i:j], wo[lo:hi].T, out=part)
        part += bo[lo:hi]
        at = to
    return logit, begin, width


def score(p: dict, lay: Layout, docs: list[np.ndarray], batch: int = 256, window: int = 64) -> np.ndarray:
    """Natural log probability of each document (token ids, the last one the end); the state is carried from window to window."""
    out = np.zeros(len(docs))
    gates = p["emb"] @ p["wx"] + p["bx"]
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    for start in range(0, len(order), batch):
        own = order[start : start + batch]
        size = np.array([len(docs[i]) for i in own])
        h = np.zeros((len(own), HIDDEN), np.float32)
        before = np.zeros(len(own), int)  # the end, place 0, stands before the first word
        for t in range(0, size[0], window):
            live = int((size > t).sum())
            steps = min(window, size[0] - t)
            ids = np.zeros((live, steps), int)
            for k in range(live):
                part = docs[own[k]][t : t + steps]
                ids[k, : len(part)] = part
            h = h[:live]
            before = np.concatenate([before[:live, None], ids[:, :-1]], axis=1)
            states, rows, targets = [], [], []
            for s in range(steps):
                n = int((size[:live] > t + s).sum())
                h = _step(gates[before[:n, s]], h[:n], p["uh"])
                states.append(h)
                rows.append(np.arange(n))
                targets.append(ids[:n, s])
            rows = np.concatenate(rows)
            got = log_probs(p, lay, np.concatenate(states), np.concatenate(targets))
            out[own] += np.bincount(rows, weights=got, minlength=len(own))
            before = ids[: len(h), -1]
    return out


def train(p: dict, lay: Layout, docs: list[np.ndarray], streams: int = 48, window: int = 24, rate: float = 0.01) -> tuple[dict, int]:
    """One pass of truncated backpropagation with Adam over the documents, laid end to end in ``streams`` rows.

    The state goes on from window to window within a document and starts anew with each one.
    The last row is filled up from the first documents, so no token is left out.
    """
    if not docs:
        return {n: v.copy() for n, v in p.items()}, 0
    line = np.concatenate(docs)
    begins = np.zeros(len(line), bool)
    begins[np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]]).astype(int)] = True
    streams = max(1, min(streams, len(line) // window))
    long = -(-len(line) // streams)
    # a row for each step, so that those of a window lie together
    ids, fresh = (np.ascontiguousarray(np.resize(v, (streams, long)).T) for v in (line, begins))
    before = np.concatenate([np.zeros((1, streams), int), ids[:-1]])
    # weights, gradients and Adam's moments are one array each, of which the named ones are views
    weights, shape = flat(p), p
    grads, m, v = (np.zeros_like(weights) for _ in range(3))
    p, g = _views(weights, shape), _views(grads, shape)
    h = np.zeros((streams, HIDDEN), np.float32)
    n = HIDDEN
    for update, t in enumerate(range(0, long, window), 1):
        at = slice(t, min(t + window, long))
        steps = at.stop - at.start
        new = fresh[at, :, None]
        some = new.any(axis=(1, 2))
        total = steps * streams
        # forward
        inputs = before[at].ravel()
        embedded = p["emb"][inputs]
        x = embedded @ p["wx"]
        x += p["bx"]
        x = x.reshape(steps, streams, 3 * n)
        old, c, states = (np.empty((steps, streams, n), np.float32) for _ in range(3))
        made, gate = np.empty((steps, streams, 3 * n), np.float32), np.empty((steps, streams, 2 * n), np.float32)
        for s in range(steps):
            old[s] = np.where(new[s], np.float32(0), h) if some[s] else h
            h = _step(x[s], old[s], p["uh"], made[s], gate[s], c[s], states[s])
        hs, target = states.reshape(total, n), ids[at].ravel()
        # output layer
        grads[:] = 0
        d = hs @ p["wc"]
        d += p["bc"]
        _softmax_error(d, lay.class_of[target])
        np.matmul(hs.T, d, out=g["wc"])
        np.add.reduce(d, axis=0, out=g["bc"])
        dh = d @ p["wc"].T
        order, ends = _by_class(lay, target)
        order = order[: ends[-1]]
        own, back = hs[order], np.empty((len(order), n), np.float32)
        d, begin, width = _word_logits(p["wo"], p["bo"], lay, own, ends)
        d -= np.repeat(np.maximum.reduceat(d, begin), width)
        np.exp(d, out=d)
        d /= np.repeat(np.add.reduceat(d, begin), width)
        d[begin + lay.place_of[target[order]]] -= 1
        i = 0
        for a, b, lo, hi in lay.runs(ends):
            part = d[i : (i := i + (b - a) * (hi - lo))].reshape(b - a, hi - lo)
            np.matmul(part.T, own[a:b], out=g["wo"][lo:hi])
            np.add.reduce(part, axis=0, out=g["bo"][lo:hi])
            np.matmul(part, p["wo"][lo:hi], out=back[a:b])
        dh[order] += back
        # backward in time, cut at the window's start
        dh = dh.reshape(steps, streams, n)
        dx, da = (np.empty((steps, streams, 3 * n), np.float32) for _ in range(2))
        r, z, a = gate[:, :, :n], gate[:, :, n:], made[:, :, 2 * n :]
        to_c, to_z, to_r = (1 - z) * (1 - c * c), (old - c) * z * (1 - z), a * r * (1 - r)
        carry, up = np.zeros((streams, n), np.float32), p["uh"].T
        for s in reversed(range(steps)):
            e = dh[s]
            e += carry
            dc, dr = e * to_c[s], da[s, :, :n]
            np.multiply(dc, to_r[s], out=dr)
            np.multiply(e, to_z[s], out=da[s, :, n : 2 * n])
            np.multiply(dc, r[s], out=da[s, :, 2 * n :])
            dx[s, :, 2 * n :] = dc
            carry = da[s] @ up
            e *= z[s]
            carry += e
            if some[s]:
                carry = np.where(new[s], np.float32(0), carry)
        dx[:, :, : 2 * n] = da[:, :, : 2 * n]
        np.matmul(old.reshape(total, n).T, da.reshape(total, 3 * n), out=g["uh"])
        dx = dx.reshape(total, 3 * n)
        np.matmul(embedded.T, dx, out=g["wx"])
        np.add.reduce(dx, axis=0, out=g["bx"])
        for k, column in enumerate((dx @ p["wx"].T).T):
            g["emb"][:, k] = np.bincount(inputs, weights=column, minlength=len(g["emb"]))
        for k in range(0, len(weights), 1 << 15):  # weights at a time, so that they stay in the cache
            part = slice(k, k + (1 << 15))
            _adam(weights[part], grads[part], m[part], v[part], update, total, rate)
    return {name: x.copy() for name, x in p.items()}, len(line)


def _views(x: np.ndarray, like: dict) -> dict:
    """The parts of a flat array, by name, in the order of ``flat``."""
    out, at = {}, 0
    for n in NAMES:
        out[n] = x[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def _softmax_error(logit: np.ndarray, at: np.ndarray) -> None:
    """In place: softmax of each row, less one at its place ``at``."""
    logit -= np.maximum.reduce(logit, axis=1, keepdims=True)
    np.exp(logit, out=logit)
    logit /= np.add.reduce(logit, axis=1, keepdims=True)
    logit[np.arange(len(at)), at] -= 1


def _adam(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, update: int, total: int, rate: float) -> None:
    """One update of p by the summed gradients g of ``total`` tokens, in place; g is used up."""
    g /= total
    step = g - m
    step *= 0.1
    m += step
    g *= g
    g -= v
    g *= 0.01
    v += g
    np.divide(v, 1 - 0.99**update, out=step)
    np.sqrt(step, out=step)
    step += 1e-5
    np.divide(m, step, out=step)
    step *= rate / (1 - 0.9**update)
    p -= step
