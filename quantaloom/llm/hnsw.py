"""A hierarchical navigable small-world graph over unit vectors, searched for many queries at a time with numpy."""

from __future__ import annotations

import numpy as np

#: Links of a node above the ground level and on it; beam while building; nodes expanded at a time.
LINKS, GROUND, BUILD_BEAM, AT_ONCE = 12, 24, 48, 4
#: Queries searched together; nodes inserted together, at most.
TOGETHER, INSERTED = 256, 256


def _levels(n: int, seed: int) -> np.ndarray:
    return np.minimum(8, (-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(LINKS)).astype(int))


class Graph:
    """Nodes are rows of ``x`` (unit length, float32). Each level has a table of neighbours, -1 where there is none."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        level = _levels(n, seed)
        self.order = np.argsort(-level, kind="stable")  # high nodes first, so that each level's entry is there
        self.tables: list[np.ndarray] = []
        self.entry = int(self.order[0])
        for k in range(int(level.max()) + 1):
            self.tables.append(np.full((n, GROUND if k == 0 else LINKS), -1, np.int32))
        top = int(level[self.entry])
        at = 1
        while at < n:
            new = self.order[at : at + min(at, INSERTED)]
            new = new[level[new] == level[new[0]]]  # of one level, and none more than there are nodes already
            self._insert(new, int(level[new[0]]), top)
            at += len(new)

    def _insert(self, new: np.ndarray, level: int, top: int) -> None:
        q = self.x[new]
        start = np.full((len(new), 1), self.entry, np.int32)
        for k in range(top, -1, -1):
            if k > level:
                start = self._beam(q, start, k, 1)[0]
                continue
            ids, sims = self._beam(q, start, k, BUILD_BEAM)
            start = ids
            chosen = self._diverse(ids, sims, self.tables[k].shape[1] // 2)
            self.tables[k][new, : chosen.shape[1]] = chosen
            self._link_back(new, chosen, k)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row of candidates (best first, -1: none) those nearer to the row than to any chosen before."""
        rows, c = ids.shape
        v = self.x[np.maximum(ids, 0)]
        among = np.matmul(v, v.transpose(0, 2, 1))
        chosen, count = np.zeros((rows, c), bool), np.zeros(rows, int)
        nearest = np.full((rows, c), -np.inf, np.float32)  # to any chosen one
        for j in range(c):
            take = (ids[:, j] >= 0) & (count < most) & (sims[:, j] > nearest[:, j])
            chosen[:, j] = take
            count += take
            np.maximum(nearest, among[:, j], out=nearest, where=take[:, None])
        # Room that is left goes to the nearest of the rest.
        rank = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, rank, 1)
        return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, new: np.ndarray, chosen: np.ndarray, k: int) -> None:
        table = self.tables[k]
        to, by = chosen.ravel(), np.repeat(new, chosen.shape[1])
        to, by = to[to >= 0], by[to >= 0]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        nodes, at, counts = np.unique(to, return_index=True, return_counts=True)
        have = (table[nodes] >= 0).sum(1)
        width = table.shape[1]
        full = []
        for node, a, c, h in zip(nodes.tolist(), at.tolist(), counts.tolist(), have.tolist(), strict=True):
            if h + c <= width:
                table[node, h : h + c] = by[a : a + c]
            else:
                full.append((node, np.concatenate([table[node, :h], by[a : a + c]])))
        if not full:
            return
        most = max(len(c) for _, c in full)
        ids = np.full((len(full), most), -1, np.int32)
        for i, (_, c) in enumerate(full):
            ids[i, : len(c)] = c
        own = np.array([node for node, _ in full])
        sims = np.where(ids >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(ids, 0)], self.x[own]), -np.inf)
        best = np.argsort(-sims, axis=1, kind="stable")
        table[own] = self._diverse(np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1), width)

    def _beam(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best found of each row, best first; -1 and -inf where there are fewer."""
        table, rows = self.tables[k], np.arange(len(q))[:, None]
        visited = np.zeros((len(q), len(self.x) + 1), bool)
        visited[:, -1] = True  # where -1 points
        start = start[:, : max(1, min(beam, start.shape[1]))]
        visited[rows, start] = True
        sims = np.where(start >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(start, 0)], q), -np.inf).astype(np.float32)
        ids, done = start.astype(np.int32), start < 0
        while True:
            open_ = np.where(done, -np.inf, sims)
            some = np.flatnonzero((open_ > -np.inf).any(1))
            if not len(some):
                break
            e = min(AT_ONCE, open_.shape[1])
            pick = np.argpartition(-open_[some], e - 1, axis=1)[:, :e] if open_.shape[1] > e else np.tile(np.arange(e), (len(some), 1))
            live = np.take_along_axis(open_[some], pick, 1) > -np.inf
            near = np.where(live[:, :, None], table[np.maximum(np.take_along_axis(ids[some], pick, 1), 0)], -1).reshape(len(some), -1)
            sub = done[some]
            np.put_along_axis(sub, pick, True, 1)
            done[some] = sub
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where(visited[some[:, None], near], -1, near)
            visited[some[:, None], near] = True
            got = np.einsum("ijk,ik->ij", self.x[np.maximum(near, 0)], q[some])
            got = np.where(near >= 0, got, -np.inf).astype(np.float32)
            if len(some) < len(q):
                width = near.shape[1]
                near_all, got_all = np.full((len(q), width), -1, np.int32), np.full((len(q), width), -np.inf, np.float32)
                near_all[some], got_all[some] = near, got
                near, got = near_all, got_all
            ids, sims, done = np.hstack([ids, near]), np.hstack([sims, got]), np.hstack([done, near < 0])
            if ids.shape[1] > beam:
                keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, done = (np.take_along_axis(a, keep, 1) for a in (ids, sims, done))
        best = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the nearest ``beam`` nodes found of each row of ``q``."""
        start = np.full((len(q), 1), self.entry, np.int32)
        for k in range(len(self.tables) - 1, 0, -1):
            start = self._beam(q, start, k, 4)[0]
        return self._beam(q, start, 0, beam)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, node) of at least this similarity. A row whose whole beam fits is asked again with a wider
        one; a beam as wide as a quarter of the graph becomes the exact scan."""
        q = np.ascontiguousarray(q, np.float32)
        rows, nodes = [], []
        left = np.arange(len(q))
        while len(left):
            again = []
            for k in range(0, len(left), TOGETHER):
                part = left[k : k + TOGETHER]
                if 4 * beam >= len(self.x):
                    r, c = np.nonzero(q[part] @ self.x.T >= least)
                    rows.append(part[r])
                    nodes.append(c)
                    continue
                ids, sims = self.search(q[part], beam)
                full = (sims >= least).all(1) & (ids.shape[1] >= beam)
                again.append(part[full])
                r, c = np.nonzero((sims >= least) & ~full[:, None])
                rows.append(part[r])
                nodes.append(ids[r, c])
            left = np.concatenate(again) if again else np.zeros(0, int)
            beam *= 4
        return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(nodes) if nodes else np.zeros(0, int)
