"""Finding runs of bytes in Arrow strings with numpy, and turning byte places into code points."""

from __future__ import annotations

import numpy as np

CONTINUATION = (np.arange(256) & 0xC0) == 0x80


def byte_class(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


def runs(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of a class, at least so long; a run never crosses a row's edge."""
    solid = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


class CodePoints:
    """Code points before each byte of a chunk, counted from the start of the row; made when first asked for."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.total = raw, None

    def __call__(self, row_start: int, at):
        if self.total is None:
            self.total = np.concatenate([[0], np.cumsum(~CONTINUATION[self.raw])])
        return self.total[at] - self.total[row_start]
