"""A gated recurrent language model in numpy: class-factored output softmax, truncated backpropagation, carried state.

Symbols are numbers: `words` of them are single words in classes of `SIZE`, the others are classes of words that are told
apart elsewhere. P(symbol) = P(class | state) * P(word | class, state). Documents run in lanes, one after the
other, so that all lanes of a window make one matrix; a lane's state is carried from window to window and set to zero where
a document begins, so each document is read as a whole whatever its length. Gradients go back to the start of a window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Units of the state, numbers that stand for a symbol, words of a class, steps that gradients go back, lanes, and tokens of a
#: window when nothing is learnt.
UNITS, PLACES, SIZE, STEPS, LANES, WINDOW = 16, 16, 64, 16, 512, 8192
RATE, MOMENTS = 0.015, (0.9, 0.99)


@dataclass
class Gru:
    """e: symbols as vectors; x, a: what these add to the gates (reset, update, new); u: what the state adds; v, c: classes; w, b: words."""

    e: np.ndarray
    x: np.ndarray
    a: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray
    w: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, words: int, seed: int = 5) -> Gru:
        """Knows the symbols' frequencies only. `words` is a multiple of SIZE."""
        r, n = np.random.default_rng(seed), words // SIZE
        counts = counts.astype(np.float64) + 1
        classes = np.concatenate([counts[:words].reshape(n, SIZE).sum(1), counts[words:]])
        f = lambda *shape: (r.normal(size=shape) * 0.1).astype(np.float32)
        logs = lambda a: np.log(a / a.sum(-1, keepdims=True)).astype(np.float32)
        return cls(f(len(counts), PLACES), 2 * f(PLACES, 3 * UNITS), np.zeros(3 * UNITS, np.float32), f(UNITS, 3 * UNITS), np.zeros((UNITS, len(classes)), np.float32), logs(classes), np.zeros((n, UNITS, SIZE), np.float32), logs(counts[:words].reshape(n, SIZE)))

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.x, self.a, self.u, self.v, self.c, self.w, self.b]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def of(self, vector: np.ndarray) -> Gru:
        """A model of this one's shape."""
        out, at = [], 0
        for p in self.parts():
            out.append(vector[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Gru(*out)

    def classes(self, y: np.ndarray) -> np.ndarray:
        words = self.b.size
        return np.where(y < words, y // SIZE, y - words + len(self.b))

    def states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each step of symbols x (steps, lanes), from h; what backpropagation needs, if kept."""
        out, kept, adds = np.empty((*x.shape, UNITS), np.float32), [], self.e @ self.x + self.a
        for t in range(len(x)):
            if fresh[t].any():
                h = h * ~fresh[t][:, None]
            g, a = adds[x[t]], h @ self.u
            gates = g[:, : 2 * UNITS] + a[:, : 2 * UNITS]
            np.negative(gates, gates)
            np.exp(gates, gates)
            gates += 1
            np.reciprocal(gates, gates)
            reset, update, add = gates[:, :UNITS], gates[:, UNITS:], a[:, 2 * UNITS :]
            new = np.tanh(g[:, 2 * UNITS :] + reset * add)
            out[t] = new + update * (h - new)
            if keep:
                kept.append((h, reset, update, add, new))
            h = out[t]
        return out, kept

    def output(self, h: np.ndarray, y: np.ndarray, live: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Natural logarithms of P(y | h); if learning, the gradients of their negative sum for h and for v, c, w, b."""
        rows, cls = np.arange(len(y)), self.classes(y)
        whole = live.all()
        p = self.v.T @ h.T  # a column a symbol: sums over rows are fast
        p += self.c[:, None]
        logs = _softmax(p, cls, rows, learn)
        dw, db = (np.zeros_like(self.w), np.zeros_like(self.b)) if learn else (self.w, self.b)
        if learn:
            p[cls, rows] -= 1
            if not whole:
                p *= live
            dh = p.T @ self.v.T
        # the words of a class stand together from here on; 16 bits are sorted by radix
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        order = order[: np.searchsorted(cls[order], len(self.b))]
        ends = np.searchsorted(cls[order], np.arange(len(self.b) + 1))
        ours, words, there = h[order], y[order] % SIZE, live[order]
        more, back = np.empty(len(order), np.float32), np.empty((len(order) * learn, UNITS), np.float32)
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if a == b:
                continue
            mine, word, at = ours[a:b], words[a:b], rows[: b - a]
            q = self.w[k].T @ mine.T
            q += self.b[k][:, None]
            more[a:b] = _softmax(q, word, at, learn)
            if learn:
                q[word, at] -= 1
                if not whole:
                    q *= there[a:b]
                dw[k], db[k] = mine.T @ q.T, q.sum(1)
                back[a:b] = q.T @ self.w[k].T
        logs[order] += more
        logs *= live
        if not learn:
            return logs, h, []
        dh[order] += back
        return logs, dh, [h.T @ p.T, p.sum(1), dw, db]

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The state after a window, and the gradients of the window's loss for all parts."""
        hs, kept = self.states(x, fresh, h, True)
        _, dhs, out = self.output(hs.reshape(-1, UNITS), y.ravel(), live.ravel(), True)
        dhs, dg, da, was = dhs.reshape(hs.shape), np.empty((*x.shape, 3 * UNITS), np.float32), np.empty((*x.shape, 3 * UNITS), np.float32), np.empty_like(hs)
        back = np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            before, reset, update, add, new = kept[t]
            d = dhs[t] + back
            n = d * (1 - update) * (1 - new * new)
            dg[t, :, :UNITS] = da[t, :, :UNITS] = n * add * reset * (1 - reset)
            dg[t, :, UNITS : 2 * UNITS] = da[t, :, UNITS : 2 * UNITS] = d * (before - new) * update * (1 - update)
            dg[t, :, 2 * UNITS :] = n
            da[t, :, 2 * UNITS :] = n * reset
            back = d * update + da[t] @ self.u.T
            if fresh[t].any():
                back *= ~fresh[t][:, None]
            was[t] = before
        dg, de, flat = dg.reshape(-1, 3 * UNITS), np.zeros_like(self.e), x.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        de[flat[order][first]] = np.add.reduceat((dg @ self.x.T)[order], first)
        return hs[-1], [de, self.e[flat].T @ dg, dg.sum(0), was.reshape(-1, UNITS).T @ da.reshape(-1, 3 * UNITS), *out]

    def learn(self, docs: list[np.ndarray], start: int, rate: float, lanes: int = LANES) -> None:
        """One pass over documents, a step of Adam a window. `start` is the symbol before a document's first."""
        m = [np.zeros_like(p) for p in self.parts()]
        s = [np.zeros_like(p) for p in self.parts()]
        h, n, (a, b) = np.zeros((0, UNITS), np.float32), 0, MOMENTS
        for x, y, fresh, live in windows(docs, start, lanes, lambda k: STEPS):
            k = x.shape[1]
            h = h[:k] if len(h) >= k else np.zeros((k, UNITS), np.float32)
            h, found = self.gradients(x, y, fresh, live, h)
            n += 1
            step = np.float32(rate * np.sqrt(1 - b**n) / (1 - a**n))
            for p, g, i, j in zip(self.parts(), found, m, s, strict=True):
                g /= np.float32(lanes * STEPS)
                i += np.float32(1 - a) * (g - i)
                g *= g
                j += np.float32(1 - b) * (g - j)
                p -= step * i / (np.sqrt(j) + np.float32(1e-6))

    def scores(self, docs: list[np.ndarray], start: int, lanes: int = 2 * LANES) -> np.ndarray:
        """The natural logarithm of each whole document's probability."""
        plan = Lanes(docs, lanes)
        sums = np.zeros(len(docs))
        h = np.zeros((0, UNITS), np.float32)
        for at, (x, y, fresh, live) in plan.cut(start, lambda k: min(512, max(STEPS, WINDOW // k))):
            k = x.shape[1]
            h = h[:k] if len(h) >= k else np.zeros((k, UNITS), np.float32)
            hs, _ = self.states(x, fresh, h, False)
            h = hs[-1]
            logs = self.output(hs.reshape(-1, UNITS), y.ravel(), live.ravel(), False)[0].reshape(x.shape).astype(np.float64)
            sums += np.bincount(plan.owner(at, x.shape).ravel(), weights=logs.ravel(), minlength=len(docs))
        return sums


def _softmax(p: np.ndarray, y: np.ndarray, columns: np.ndarray, all_: bool) -> np.ndarray:
    """Logarithms of the probabilities of rows y of each column; p becomes all probabilities, if wanted."""
    p -= p.max(0)
    at = p[y, columns]
    np.exp(p, p)
    total = p.sum(0)
    if all_:
        p /= total
    return at - np.log(total)


class Lanes:
    """Documents in lanes, the longest first, each where the least is; lanes by length."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        self.docs = docs
        heap, dealt = [(0, k) for k in range(min(lanes, len(docs)))], [[] for _ in range(min(lanes, len(docs)))]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, k = heapq.heappop(heap)
            dealt[k].append(i)
            heapq.heappush(heap, (n + len(docs[i]), k))
        sizes = [sum(len(docs[i]) for i in d) for d in dealt]
        order = sorted(range(len(dealt)), key=lambda k: -sizes[k])
        self.dealt, self.sizes = [dealt[k] for k in order], np.array([sizes[k] for k in order], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate([docs[i] for d in self.dealt for i in d]).astype(np.int32) if docs else np.zeros(0, np.int32)
        lens = np.array([len(docs[i]) for d in self.dealt for i in d], np.int64)
        self.who = np.repeat(np.array([i for d in self.dealt for i in d], np.int64), lens)
        self.first = np.zeros(len(self.ids), bool)
        self.first[np.cumsum(lens) - lens] = True

    def places(self, at: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids of a window's steps, and whether the lane is that long."""
        t = at + np.arange(shape[0])[:, None]
        live = t < self.sizes[: shape[1]]
        return np.where(live, self.starts[: shape[1]] + t, 0), live

    def owner(self, at: int, shape: tuple[int, int]) -> np.ndarray:
        return self.who[self.places(at, shape)[0]]

    def cut(self, start: int, steps) -> Iterator[tuple[int, tuple]]:
        """Windows (input symbols, symbols, whether a document begins, whether there is one) of the lanes that are not at their end."""
        at, longest = 0, int(self.sizes[0]) if len(self.sizes) else 0
        while at < longest:
            k = int(np.searchsorted(-self.sizes, -at, "left"))
            n = min(steps(k), longest - at)
            place, live = self.places(at, (n, k))
            y = np.where(live, self.ids[place], 0)
            fresh = self.first[place] & live
            x = np.where(fresh, start, self.ids[place - (place > 0)])
            yield at, (x, y, fresh, live)
            at += n


def windows(docs: list[np.ndarray], start: int, lanes: int, steps) -> Iterator[tuple]:
    for _, window in Lanes(docs, lanes).cut(start, steps):
        yield window
