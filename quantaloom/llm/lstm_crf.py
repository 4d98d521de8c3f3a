"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy.

Characters are bytes that begin a code point. Gates use the piecewise linear sigmoid and tanh, which are exact, cheap
and easy to differentiate. Windows overlap; their scores are averaged by position, and one Viterbi pass over each whole text
decides. Places that no way off tag 0 can pass and win by cut that pass into short ones, exactly.
"""

from __future__ import annotations

import numpy as np

#: Characters of a window; its step; characters that it shares with a neighbour, where the weight of its scores falls towards its end.
WINDOW, STEP = 256, 224
SHARED = WINDOW - STEP
#: Places of a block of the Viterbi pass.
BLOCK = 48
EMBED, STATE = 8, 8
G = 4 * STATE


def hard_sigmoid(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


class Tagger:
    def __init__(self, tags: int, seed: int = 4):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": small(257, EMBED) * 8, "Wf": small(EMBED, G), "Wb": small(EMBED, G), "bf": np.zeros(G, np.float32), "bb": np.zeros(G, np.float32), "Uf": small(STATE, G), "Ub": small(STATE, G), "O": small(2 * STATE, tags), "c": np.zeros(tags, np.float32), "T": np.zeros((tags, tags), np.float32)}
        for b in ("bf", "bb"):
            self.p[b][STATE : 2 * STATE] = 2  # remember at first
        self.tags = tags

    # ------------------------------------------------------------ network

    def _direction(self, x: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States (place, window, STATE) for characters (place, window); order of gates: in, forget, out, new."""
        table = self.p["E"] @ self.p["W" + side] + self.p["b" + side]
        u, places, s = self.p["U" + side], range(len(x)), STATE
        h = c = np.zeros((x.shape[1], s), np.float32)
        states = np.empty((*x.shape, s), np.float32)
        for t in places if side == "f" else reversed(places):
            z = h @ u
            z += table[x[t]]
            gates = z[:, : 3 * s] * np.float32(0.25)
            gates += np.float32(0.5)
            np.minimum(gates, 1, out=gates)
            np.maximum(gates, 0, out=gates)
            new = np.minimum(z[:, 3 * s :], 1)
            np.maximum(new, -1, out=new)
            before = c
            c = gates[:, s : 2 * s] * c
            c += gates[:, :s] * new
            squashed = np.minimum(c, 1)
            np.maximum(squashed, -1, out=squashed)
            if keep is not None:
                keep.append((t, h, before, z, gates, new, c, squashed))
            h = gates[:, 2 * s :] * squashed
            states[t] = h
        return states

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores (place, window, tag) for characters (place, window); 256 stands outside the text."""
        steps = ([], []) if keep is not None else (None, None)
        f, b = self._direction(x, "f", steps[0]), self._direction(x, "b", steps[1])
        out = f @ self.p["O"][:STATE]
        out += b @ self.p["O"][STATE:]
        out += self.p["c"]
        if keep is not None:
            keep.update(f=f, b=b, steps=steps, x=x)
        return out

    def _read(self, x: np.ndarray, side: str) -> np.ndarray:
        """As ``_direction``, laid out (place, STATE, window) so that every operation runs along the windows; the scale of
        the piecewise linear gates is put into the weights."""
        s, n = STATE, x.shape[1]
        scale, shift = np.ones(G, np.float32), np.zeros(G, np.float32)
        scale[: 3 * s], shift[: 3 * s] = 0.25, 0.5
        table = np.ascontiguousarray(((self.p["E"] @ self.p["W" + side] + self.p["b" + side]) * scale + shift).T)
        u = np.ascontiguousarray((self.p["U" + side] * scale).T)
        states = np.empty((len(x), s, n), np.float32)
        h, c = np.zeros((s, n), np.float32), np.zeros((s, n), np.float32)
        z, given, part = (np.empty((k, n), np.float32) for k in (G, G, s))
        rows = list(zip(table, given, strict=True))
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            np.matmul(u, h, out=z)
            at = x[t]
            for row, to in rows:
                row.take(at, 0, to, "clip")
            z += given
            np.clip(z[: 3 * s], 0, 1, out=z[: 3 * s])
            np.clip(z[3 * s :], -1, 1, out=z[3 * s :])
            c *= z[s : 2 * s]
            np.multiply(z[:s], z[3 * s :], out=part)
            c += part
            np.clip(c, -1, 1, out=part)
            h = states[t]
            np.multiply(z[2 * s : 3 * s], part, out=h)
        return states

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores (place, tag but 0, window) over those of tag 0, for characters (window, place)."""
        weights = np.ascontiguousarray((self.p["O"][:, 1:] - self.p["O"][:, :1]).T)
        part = np.ascontiguousarray(x.T, dtype=np.intp)
        e = np.matmul(weights[:, :STATE], self._read(part, "f"))
        e += np.matmul(weights[:, STATE:], self._read(part, "b"))
        e += (self.p["c"][1:] - self.p["c"][0])[:, None]
        return e

    def open_places(self, d: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places that a way off tag 0 might pass and win by.

        Such a way enters, gains so much a place at most, and leaves. The best bound over all entries before a place and all
        exits behind it comes from running sums and running maxima; places where it stays below nought have tag 0.
        """
        t = self.p["T"].astype(np.float64)
        over = t - t[0, 0]
        enter, inside = ((d + shift.astype(np.float32)[:, None]).max(0).astype(np.float64) for shift in (over[0, 1:], over[1:, 1:].max(0)))
        leave = np.full(d.shape[1], over[1:, 0].max())
        begin, end = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
        enter[begin], leave[end - 1] = d[:, begin].max(0), np.maximum(0, leave[end - 1])
        inside[begin] = -1e6  # nothing passes from text to text
        gained = np.cumsum(inside)
        enter -= gained
        leave += gained
        best = np.maximum.accumulate(enter) + np.maximum.accumulate(leave[::-1])[::-1]
        return np.flatnonzero(best >= -1e-2)

    def paths(self, d: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best tags of whole texts with scores (tag but 0, place) over those of tag 0, texts one after the other.

        Runs of open places are cut into blocks. The best way through a block is found for every tag before it, all blocks
        side by side; ways are then chained over the blocks of a run, and followed back.
        """
        out = np.zeros(d.shape[1], np.int8)
        places = self.open_places(d, offsets) if d.shape[1] else np.zeros(0, np.int64)
        if not len(places):
            return out
        text = np.searchsorted(offsets, places, "right") - 1
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(places) > 1) | (np.diff(text) > 0)]))
        length = np.diff(np.append(begin, len(places)))
        trans, k = self.p["T"].astype(np.float64), self.tags
        e = np.concatenate([np.zeros((len(places), 1)), d[:, places].T], axis=1)
        # blocks, the longest first
        many = -(-length // BLOCK)
        run = np.repeat(np.arange(len(begin)), many)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        start, size = begin[run] + nth * BLOCK, np.minimum(BLOCK, length[run] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        begun = np.where((places[begin] > offsets[text[begin]])[:, None], trans[0], 0)  # tag 0 stands before
        best = np.where((nth == 0)[:, None, None], begun[run][:, None, :], trans) + e[start][:, None, :]
        best = best[order]
        back = np.zeros((len(places), k, k), np.int8)
        longer = np.searchsorted(-size[order], -np.arange(BLOCK), "left")  # blocks of more than t places
        at = start[order]
        for t in range(1, int(size.max())):
            m = longer[t]
            given = best[:m, :, :, None] + trans
            back[at[:m] + t] = given.argmax(2)
            best[:m] = given.max(2) + e[at[:m] + t][:, None, :]
        ways = np.empty_like(best)
        ways[order] = best
        # over the blocks of each run, those of most blocks first
        head, by = np.cumsum(many) - many, np.argsort(-many, kind="stable")
        more = np.searchsorted(-many[by], -np.arange(int(many.max())), "left")
        score, came = ways[head[by], 0], np.zeros((len(run), k), np.int8)
        for j in range(1, int(many.max())):
            m = more[j]
            given = score[:m, :, None] + ways[head[by[:m]] + j]
            came[head[by[:m]] + j] = given.argmax(1)
            score[:m] = given.max(1)
        last = begin + length - 1
        score += np.where((places[last] < offsets[text[last] + 1] - 1)[by][:, None], trans[:, 0], 0)  # and behind
        ends, before = np.zeros(len(run), np.int8), np.zeros(len(run), np.int8)
        ends[head[by] + many[by] - 1] = score.argmax(1)
        for j in range(int(many.max()) - 1, 0, -1):
            block = head[by[: more[j]]] + j
            before[block] = came[block, ends[block]]
            ends[block - 1] = before[block]
        tag = np.zeros(len(places), np.int8)
        tag[start + size - 1] = ends
        given = before[order]
        for t in range(int(size.max()) - 1, 0, -1):
            m = longer[t]
            tag[at[:m] + t - 1] = back[at[:m] + t, given[:m], tag[at[:m] + t]]
        out[places] = tag
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Tags (window, place) for characters (window, place), each window a text."""
        d = self.scores(x).transpose(1, 2, 0).reshape(self.tags - 1, -1)
        return self.paths(d, np.arange(len(x) + 1) * x.shape[1]).reshape(x.shape)

    # ------------------------------------------------------------ training

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(mean negative log-likelihood, gradient of scores, gradient of transitions)."""
        t_all, n, k = e.shape
        trans = self.p["T"]
        lse = lambda a, axis: (m := a.max(axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, t_all):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(t_all - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        d_e = np.exp(alpha + beta - total[:, None])
        d_t = np.zeros_like(trans)
        rows, truth = np.arange(n), 0.0
        for t in range(t_all):
            truth += e[t, rows, y[t]].sum()
            if t:
                truth += trans[y[t - 1], y[t]].sum()
                d_t += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
                np.subtract.at(d_t, (y[t - 1], y[t]), 1)
            d_e[t, rows, y[t]] -= 1
        return float(total.sum() - truth) / n, d_e / n, d_t / n

    def _back(self, d_states: np.ndarray, side: str, steps: list, x: np.ndarray, grad: dict) -> None:
        u, w, s = self.p["U" + side], self.p["W" + side], STATE
        d_u, d_gates = np.zeros_like(u), np.empty((*x.shape, G), np.float32)
        d_h = d_c = np.zeros((x.shape[1], s), np.float32)
        for t, h, before, z, gates, new, c, squashed in reversed(steps):
            d_h = d_h + d_states[t]
            d_c = d_c + d_h * gates[:, 2 * s :] * (np.abs(c) < 1)
            d_z = np.concatenate([d_c * new, d_c * before, d_h * squashed, d_c * gates[:, :s] * (np.abs(z[:, 3 * s :]) < 1)], axis=1)
            d_z[:, : 3 * s] *= 0.25 * (np.abs(z[:, : 3 * s]) < 2)
            d_u += h.T @ d_z
            d_gates[t] = d_z
            d_h, d_c = d_z @ u.T, d_c * gates[:, s : 2 * s]
        flat, d_table = x.ravel(), np.zeros((257, G), np.float32)
        order = np.argsort(flat, kind="stable")  # sums by character
        found, starts = np.unique(flat[order], return_index=True)
        d_table[found] = np.add.reduceat(d_gates.reshape(-1, G)[order], starts)
        grad["U" + side], grad["b" + side], grad["W" + side] = d_u, d_table.sum(0), self.p["E"].T @ d_table
        grad["E"] = grad.get("E", 0) + d_table @ w.T

    def step(self, x: np.ndarray, y: np.ndarray, moments: dict, rate: float) -> float:
        """One Adam step on windows of characters and tags, both (window, place)."""
        keep: dict = {}
        x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        loss, d_e, d_t = self._crf(self.emissions(x, keep), y)
        flat = d_e.reshape(-1, self.tags)
        grad = {"T": d_t, "c": flat.sum(0), "O": np.concatenate([keep[s].reshape(-1, STATE).T @ flat for s in "fb"])}
        for k, side in enumerate("fb"):
            self._back(d_e @ self.p["O"][k * STATE : (k + 1) * STATE].T, side, keep["steps"][k], x, grad)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        moments["t"] = moments.get("t", 0) + 1
        for name, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9)) + 1e-6 * self.p[name]
            m, v = moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            moments[name] = m, v
            self.p[name] -= (rate * m / (1 - 0.9 ** moments["t"]) / (np.sqrt(v / (1 - 0.99 ** moments["t"])) + 1e-8)).astype(np.float32)
        return loss
