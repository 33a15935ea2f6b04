"""A gated recurrent language model in numpy with a class-factored softmax.

The network reads the previous token's symbol and predicts the class of the next token; within the classes of
frequent words it predicts the word too. A symbol is a frequent word, or the class of any other word.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
#: Steps of backpropagation, streams trained side by side at most, and updates that a call makes at least.
WINDOW, STREAMS, UPDATES = 24, 256, 24
#: Adagrad: step size, bound of a gradient, and what the sums of squares begin with.
RATE, CLIP, FIRST_SUM = 0.07, 1.0, 1e-7
#: Documents are dealt over so many streams for scoring, and outputs are computed for so many steps at once.
SLOTS, STEPS = 384, 128
#: Rows of a softmax at once, so that they stay in a core's cache.
ROWS = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Overwrites ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _with_ones(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of symbols or classes, which are below 2**16, and the sorted values."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    return order, x.take(order)


def _softmax(logits: np.ndarray, tame: bool) -> np.ndarray:
    """Softmax of each row; overwrites ``logits``. Tame ones need no shift to keep exponentials finite and above zero."""
    if not tame:
        logits -= logits.max(axis=1)[:, None]
    np.exp(logits, out=logits)
    logits *= (1 / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]
    return logits


def _log_softmax_at(logits: np.ndarray, at: np.ndarray, tame: bool) -> np.ndarray:
    """Log-softmax of each row at one place; overwrites ``logits``."""
    if not tame:
        logits -= logits.max(axis=1)[:, None]
    chosen = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return chosen - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


class Gru:
    """``words`` frequent words in class order; ``first[c]:first[c + 1]`` are those of word class c.

    Symbols are 0..words-1, then one for each of the other classes, then the start of a document. Classes are the
    word classes, then the others.
    """

    #: The last row of ``classes`` and the last column of ``outputs`` are biases; states get a last column of ones.
    NAMES = ("inputs", "recurrent", "classes", "outputs")

    def __init__(self, first: np.ndarray, word_counts: np.ndarray, other_mass: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.first, self.words, self.others = first, int(first[-1]), len(other_mass)
        self.word_classes = len(first) - 1
        self.class_of = np.repeat(np.arange(self.word_classes), np.diff(first))
        self.start = self.words + self.others
        mass = np.concatenate([np.add.reduceat(word_counts + 1.0, first[:-1]), other_mass])
        scale = 1 / np.sqrt(HIDDEN)
        self.inputs = rng.normal(0, 0.3, (self.start + 1, 3 * HIDDEN)).astype(np.float32)
        self.recurrent = rng.normal(0, scale, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.classes = np.zeros((HIDDEN + 1, len(mass)), np.float32)
        self.classes[HIDDEN] = np.log(mass / mass.sum())
        self.outputs = np.zeros((self.words, HIDDEN + 1), np.float32)
        self.outputs[:, HIDDEN] = np.log((word_counts + 1.0) / np.repeat(mass[: self.word_classes], np.diff(first)))
        self.sums = {name: np.full(getattr(self, name).shape, FIRST_SUM, np.float32) for name in self.NAMES}

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def state(self) -> np.ndarray:
        """The weights, then the sums of squared gradients."""
        return np.concatenate([self.weights(), *(self.sums[n].ravel() for n in self.NAMES)])

    def load(self, flat: np.ndarray) -> None:
        """Take over weights, or a state."""
        at = 0
        for kept in (self.__dict__, self.sums)[: 2 if flat.size > sum(s.size for s in self.sums.values()) else 1]:
            for name in self.NAMES:
                size, shape = kept[name].size, kept[name].shape
                kept[name] = flat[at : at + size].reshape(shape).astype(np.float32)
                at += size

    def targets(self, symbols: np.ndarray) -> np.ndarray:
        """Classes of symbols."""
        return np.where(symbols < self.words, self.class_of[np.minimum(symbols, self.words - 1)], symbols - self.words + self.word_classes)

    def tame(self) -> bool:
        """Whether no logit can be far from zero, as no part of a state exceeds one."""
        return max(np.abs(self.classes).sum(axis=0).max(), np.abs(self.outputs).sum(axis=1).max(initial=0)) < 60

    def read(self, symbols: np.ndarray) -> np.ndarray:
        """What the gates get from symbols: 3 planes of symbols x ``HIDDEN``, so that every gate is contiguous."""
        return np.ascontiguousarray(self.inputs.take(symbols, axis=0).reshape(-1, 3, HIDDEN).transpose(1, 0, 2))

    def planes(self) -> np.ndarray:
        """The recurrent weights of the three gates."""
        return np.ascontiguousarray(self.recurrent.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))

    def step(self, h: np.ndarray, symbols: np.ndarray):
        return self.advance(h, self.read(symbols), self.planes())

    def advance(self, h: np.ndarray, g: np.ndarray, planes: np.ndarray):
        """One step from states ``h``: the new states, then what they were made of. Overwrites ``g``."""
        u = np.matmul(h, planes)
        gates = g[:2]
        gates += u[:2]
        z, r = _sigmoid(gates)
        new = r * u[2]
        new += g[2]
        np.tanh(new, out=new)
        out = h - new
        out *= z
        out += new
        return out, z, r, new, u[2]

    def log_probability(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each symbol: of the word, or of its class if it is not frequent."""
        tame = self.tame()
        order, classes = _sorted(self.targets(symbols))
        edges = np.searchsorted(classes, np.arange(self.word_classes + 1)).tolist()
        h, symbols = _with_ones(h.take(order, axis=0)), symbols.take(order)
        found = np.concatenate([_log_softmax_at(h[i : i + ROWS] @ self.classes, classes[i : i + ROWS], tame) for i in range(0, len(h), ROWS)])
        for c in range(self.word_classes):
            own = slice(edges[c], edges[c + 1])
            a, b = self.first[c], self.first[c + 1]
            if edges[c + 1] > edges[c] and b - a > 1:
                found[own] += _log_softmax_at(h[own] @ self.outputs[a:b].T, symbols[own] - a, tame)
        out = np.empty_like(found)
        out[order] = found
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log-probability of each document, a sequence of symbols; its state runs through from start to end.

        Documents are dealt over slots, longest first to the emptiest slot, and a slot's documents follow each
        other with a fresh state. All slots advance together, a window of steps at a time.
        """
        if not docs:
            return np.zeros(0)
        lengths = np.array([len(d) for d in docs])
        slots = min(SLOTS, len(docs))
        load, of = np.zeros(slots, np.int64), [[] for _ in range(slots)]
        for i in np.argsort(-lengths, kind="stable").tolist():
            s = int(load.argmin())
            of[s].append(i)
            load[s] += lengths[i]
        order = np.argsort(-load, kind="stable")
        docs_in_order = [i for s in order for i in of[s]]
        load = load[order]
        flat = np.concatenate([docs[i] for i in docs_in_order])
        begins = np.cumsum(load) - load
        starts = np.cumsum(lengths[docs_in_order]) - lengths[docs_in_order]
        previous = np.concatenate([[self.start], flat[:-1]])
        previous[starts] = self.start
        scores = np.zeros(len(flat))
        h, inputs, planes = np.zeros((slots, HIDDEN), np.float32), self.read(np.arange(self.start + 1)), self.planes()
        active = np.searchsorted(-load, -np.arange(int(load[0])), "left").tolist()
        for at in range(0, int(load[0]), STEPS):
            held, places = [], []
            for step in range(at, min(at + STEPS, int(load[0]))):
                n = active[step]
                place = begins[:n] + step
                symbols = previous.take(place)
                h = h[:n]
                fresh = np.flatnonzero(symbols == self.start)
                if len(fresh):
                    h = h.copy()
                    h[fresh] = 0
                h = self.advance(h, inputs.take(symbols, axis=1), planes)[0]
                held.append(h)
                places.append(place)
            places = np.concatenate(places)
            scores[places] = self.log_probability(np.concatenate(held), flat.take(places))
        out = np.zeros(len(docs))
        out[docs_in_order] = np.add.reduceat(scores, starts)
        return out

    def train(self, docs: list[np.ndarray], seed: int) -> int:
        """One pass by truncated backpropagation through time, with Adagrad; returns the number of tokens.

        The documents follow each other in a random order, cut into streams that run side by side; a stream's state
        is carried from window to window. The streams' remainders at the end are learned as one shorter window.
        """
        if not docs:
            return 0
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(docs))
        flat = np.concatenate([docs[i] for i in order])
        previous = np.concatenate([[self.start], flat[:-1]])
        starts = np.cumsum([0] + [len(docs[i]) for i in order[:-1]])
        previous[starts] = self.start
        streams = max(1, min(STREAMS, len(flat) // (WINDOW * UPDATES)))
        n = len(flat) // streams
        x, y = previous[: n * streams].reshape(streams, n).T, flat[: n * streams].reshape(streams, n).T
        h = np.zeros((streams, HIDDEN), np.float32)
        for at in range(0, n, WINDOW):
            h = self._learn(h, np.ascontiguousarray(x[at : at + WINDOW]), y[at : at + WINDOW])
        if n * streams < len(flat):
            self._learn(h[-1:], previous[n * streams :, None], flat[n * streams :])
        return len(flat)

    def _learn(self, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """One update from a window: symbols read ``x`` and to come ``y``, steps x streams."""
        steps, streams = x.shape
        fresh = [np.flatnonzero(row == self.start) for row in x]
        before, hs, z, r, new, u = np.empty((6, steps, streams, HIDDEN), h.dtype)
        inputs, planes = self.read(x.ravel()).reshape(3, steps, streams, HIDDEN), self.planes()
        for t in range(steps):
            before[t] = h
            if len(fresh[t]):
                before[t][fresh[t]] = 0
            h, z[t], r[t], new[t], u[t] = self.advance(before[t], inputs[:, t], planes)
            hs[t] = h
        back, grads = self._output_gradients(hs.reshape(-1, HIDDEN), y.ravel())
        back = back.reshape(steps, streams, HIDDEN) / streams
        by_new = (1 - z) * (1 - new * new)
        by = np.stack([(before - new) * z * (1 - z), by_new * u * r * (1 - r), by_new * r], axis=1)  # of the recurrent part
        d_gates, d_new, turned = np.empty_like(by), np.empty_like(by_new), np.ascontiguousarray(planes.transpose(0, 2, 1))
        dh = np.zeros((streams, HIDDEN), h.dtype)
        for t in reversed(range(steps)):
            dh += back[t]
            np.multiply(dh, by_new[t], out=d_new[t])
            through = np.matmul(np.multiply(dh, by[t], out=d_gates[t]), turned)
            dh = dh * z[t]
            for part in through:
                dh += part
            if len(fresh[t]):
                dh[fresh[t]] = 0
        d_gates = d_gates.transpose(0, 2, 1, 3).reshape(-1, 3 * HIDDEN)
        grads = {name: g / streams for name, g in grads.items()}
        grads["recurrent"] = before.reshape(-1, HIDDEN).T @ d_gates
        for name, g in grads.items():
            self._update(name, slice(None), g)
        d_gates[:, 2 * HIDDEN :] = d_new.reshape(-1, HIDDEN)  # from here on of the input part
        order, read = _sorted(x.ravel())
        edges = np.flatnonzero(np.diff(read, prepend=-1))
        self._update("inputs", read[edges], np.add.reduceat(d_gates.take(order, axis=0), edges, axis=0))
        return h

    def _update(self, name: str, rows, g: np.ndarray) -> None:
        g = np.clip(g, -CLIP, CLIP)
        sums = self.sums[name][rows] + g * g
        self.sums[name][rows] = sums
        getattr(self, name)[rows] -= RATE * g / np.sqrt(sums)

    def _output_gradients(self, hs: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the summed cross entropy by hidden state and by the weights of the output side."""
        tame = self.tame()
        order, classes = _sorted(self.targets(symbols))
        edges = np.searchsorted(classes, np.arange(self.word_classes + 1)).tolist()
        hs, symbols = _with_ones(hs.take(order, axis=0)), symbols.take(order)
        back, d_classes, d_outputs = np.empty_like(hs), np.zeros_like(self.classes), np.zeros_like(self.outputs)
        for i in range(0, len(hs), ROWS):
            some = slice(i, i + ROWS)
            p = _softmax(hs[some] @ self.classes, tame)
            p[np.arange(len(p)), classes[some]] -= 1
            np.matmul(p, self.classes.T, out=back[some])
            d_classes += hs[some].T @ p
        for c in range(self.word_classes):
            own = slice(edges[c], edges[c + 1])
            a, b = self.first[c], self.first[c + 1]
            if edges[c + 1] > edges[c] and b - a > 1:
                q = _softmax(hs[own] @ self.outputs[a:b].T, tame)
                q[np.arange(len(q)), symbols[own] - a] -= 1
                d_outputs[a:b] = q.T @ hs[own]
                back[own] += q @ self.outputs[a:b]
        out = np.empty((len(hs), HIDDEN), hs.dtype)
        out[order] = back[:, :HIDDEN]
        return out, {"classes": d_classes, "outputs": d_outputs}
