"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

The input of a word is an embedding of the word itself and one of its spelling: the mean over its character n-grams
plus the mean over those that it begins with. Words and n-grams go by hashes into tables of fixed size, so nothing is
out of vocabulary. Two recurrent layers read a window forwards and backwards; attention weighs their states, and one
logit comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import gram_hashes, text_chunks, words

#: Words of a window and between the starts of windows, which overlap by half.
WINDOW, STRIDE = 32, 16
#: Sizes: word and spelling embeddings, states of each direction; windows and bytes of text at a time.
WORD_DIM, CHAR_DIM, STATE, TOGETHER, BYTES = 12, 12, 8, 2048, 1 << 19
#: Rows of the two tables (a power of two each); bytes of n-grams inside and at the start of a word.
WORDS, GRAMS = 1 << 15, 1 << 16
INNER, START = (2, 3, 4, 5), (2, 3, 4, 5, 6, 7)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PARTS = ~_LETTER


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end of the row's words) of every window; a row without words has one empty window."""
    n = np.diff(first)
    count = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, first[row] + step * STRIDE, first[row + 1]


class Spelling:
    """Table rows of the n-grams of some words, laid out by bytes; absent ones have a last row, which is zeros."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        self.first = np.concatenate([[0], np.cumsum(size)])
        word = np.repeat(np.arange(len(size)), size)
        own = raw[np.arange(len(word)) - self.first[word] + starts[word]] if len(word) else np.zeros(0, np.uint8)
        left = self.first[word + 1] - np.arange(len(word))  # bytes up to the word's end
        self.inner = np.full((len(word), len(INNER)), GRAMS, np.int32)
        self.start = np.full((len(size), len(START)), GRAMS, np.int32)
        for n in sorted({*INNER, *START}):
            h = gram_hashes(own, n)
            if n in INNER:
                at = np.flatnonzero(left >= n)
                self.inner[at, INNER.index(n)] = h[at] & np.uint64(GRAMS - 1)
            if n in START:
                at = np.flatnonzero(size >= n)
                self.start[at, START.index(n)] = (h[self.first[at]] >> np.uint64(32)) & np.uint64(GRAMS - 1)
        share = lambda count: (1 / np.maximum(1, count)).astype(np.float32)
        self.per_inner, self.per_start = share(sum(np.maximum(0, size - n + 1) for n in INNER)), share(sum((size >= n).astype(np.int64) for n in START))

    def __getitem__(self, k: np.ndarray) -> Spelling:
        """The words at these places."""
        some, size = object.__new__(Spelling), np.diff(self.first)[k]
        some.first = np.concatenate([[0], np.cumsum(size)])
        some.inner = self.inner[np.arange(some.first[-1]) - np.repeat(some.first[:-1] - self.first[k], size)]
        some.start, some.per_inner, some.per_start = self.start[k], self.per_inner[k], self.per_start[k]
        return some

    def vectors(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.start), g.shape[1]), np.float32)
        if len(self.start):
            inner = g[self.inner[:, 0]]
            for k in range(1, len(INNER)):
                inner += g[self.inner[:, k]]
            out += np.add.reduceat(inner, self.first[:-1], axis=0) * self.per_inner[:, None]
            for k in range(len(START)):
                out += g[self.start[:, k]] * self.per_start[:, None]
        return out

    def gradient(self, d: np.ndarray) -> np.ndarray:
        """Gradient of the table for d, that of the vectors."""
        inner, start = np.repeat(d * self.per_inner[:, None], np.diff(self.first), axis=0), d * self.per_start[:, None]
        rows = np.concatenate([*self.inner.T, *self.start.T])
        d_g = np.stack([np.bincount(rows, np.concatenate([*[inner[:, j]] * len(INNER), *[start[:, j]] * len(START)]), GRAMS + 1) for j in range(d.shape[1])], axis=1).astype(np.float32)
        d_g[GRAMS] = 0
        return d_g


def word_rows(h: np.ndarray) -> np.ndarray:
    """Table rows of words with these hashes; row 0 stands for a hidden word."""
    return 1 + (h & np.uint64(WORDS - 1)).astype(np.int64)


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "E": (rng.standard_normal((WORDS + 1, WORD_DIM)) * 0.02).astype(np.float32), "G": (rng.standard_normal((GRAMS + 1, CHAR_DIM)) * 0.02).astype(np.float32),
            "b": np.zeros(6 * STATE, np.float32), "W": small(WORD_DIM + CHAR_DIM, 6 * STATE) * 3, "Uf": small(STATE, 3 * STATE) * 2, "Ub": small(STATE, 3 * STATE) * 2,
            "a": small(2 * STATE, 1), "o": small(2 * STATE, 1), "c": np.zeros(1, np.float32),
        }
        self.p["E"][0] = self.p["G"][GRAMS] = 0
        self.scale, self.shift = 1.0, 0.0

    def gates(self, rows: np.ndarray, spelling: Spelling) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gate inputs) of words by their table rows."""
        x = np.concatenate([self.p["E"][rows], spelling.vectors(self.p["G"])], axis=1)
        return x, x @ self.p["W"] + self.p["b"]

    def _direction(self, g: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
        """States (window, place, STATE); g: (window, place, gates)."""
        n, t_all, s = len(g), g.shape[1], STATE
        states, h = np.empty((n, t_all, s), np.float32), np.zeros((n, s), np.float32)
        for t in range(t_all - 1, -1, -1) if back else range(t_all):
            hu = h @ u
            zr = sigmoid(g[:, t, : 2 * s] + hu[:, : 2 * s])
            new = np.tanh(g[:, t, 2 * s :] + zr[:, s:] * hu[:, 2 * s :])
            if keep is not None:
                keep.append((t, h, hu, zr, new))
            h = (new + zr[:, :s] * (h - new)) * mask[:, t, None]
            states[:, t] = h
        return states

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; a window without words has the bias alone."""
        p, s = self.p, STATE
        steps = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._direction(g[:, :, : 3 * s], mask, p["Uf"], False, steps[0]), self._direction(g[:, :, 3 * s :], mask, p["Ub"], True, steps[1])], axis=2)
        score = np.where(mask > 0, (states @ p["a"])[:, :, 0], -1e9)
        weight = np.exp(score - score.max(1, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,ntk->nk", weight, states)
        if keep is not None:
            keep.update(steps=steps, states=states, weight=weight, pooled=pooled)
        return (pooled @ p["o"])[:, 0] + p["c"][0]

    def backward(self, d: np.ndarray, mask: np.ndarray, keep: dict) -> tuple[dict, np.ndarray]:
        """(gradients but for the inputs', gradient of the gate inputs) for d, that of the logits."""
        p, s, states, weight, pooled = self.p, STATE, keep["states"], keep["weight"], keep["pooled"]
        grad = {"o": pooled.T @ d[:, None], "c": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["o"][:, 0]
        d_weight = np.einsum("nk,ntk->nt", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        grad["a"] = np.einsum("nt,ntk->k", d_score, states)[:, None]
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_score[:, :, None] * p["a"][:, 0]
        d_g = np.zeros((*states.shape[:2], 6 * s), np.float32)
        for k, name in enumerate(("Uf", "Ub")):
            u, d_u, d_h = p[name], np.zeros_like(p[name]), np.zeros((len(d), s), np.float32)
            for t, h, hu, zr, new in reversed(keep["steps"][k]):
                d_out = (d_h + d_states[:, t, k * s : (k + 1) * s]) * mask[:, t, None]
                z, r = zr[:, :s], zr[:, s:]
                d_new = d_out * (1 - z) * (1 - new * new)
                d_z = d_out * (h - new) * z * (1 - z)
                d_r = d_new * hu[:, 2 * s :] * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_g[:, t, k * 3 * s : (k + 1) * 3 * s] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_u += h.T @ d_hu
                d_h = d_out * z + d_hu @ u.T
            grad[name] = d_u
        return grad, d_g

    def logits(self, g: np.ndarray, first_word: np.ndarray, end: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Logits of windows; ``kinds`` has the row of ``g`` of each word. The last row is zeros, for places behind the end."""
        out = np.empty(len(first_word), np.float32)
        for k in range(0, len(out), TOGETHER):
            at = first_word[k : k + TOGETHER, None] + np.arange(WINDOW)
            inside = at < end[k : k + TOGETHER, None]
            at = np.where(inside, kinds[np.minimum(at, len(kinds) - 1)] if len(kinds) else 0, len(g) - 1)
            out[k : k + TOGETHER] = self.forward(g[at], inside.astype(np.float32))
        return out

    def scores(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Scores of texts, chunk by chunk: the calibrated logit of each text's strongest window."""
        for _, raw, offsets in text_chunks(column, BYTES):
            h, starts, ends, first = words(raw, offsets, PARTS)
            row, at, end = windows_of(first)
            found, place, kinds = np.unique(h, return_index=True, return_inverse=True)
            g = np.zeros((len(found) + 1, 6 * STATE), np.float32)
            g[:-1] = self.gates(word_rows(found), Spelling(raw, starts[place], ends[place]))[1]
            best = np.maximum.reduceat(self.logits(g, at, end, kinds), np.searchsorted(row, np.arange(len(offsets) - 1)))
            yield sigmoid(self.scale * best.astype(np.float64) + self.shift)
