"""Word shingles of whole texts as 64-bit hashes, made with numpy from Arrow's buffers (no Python strings)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, A-Z the same as a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
#: Bytes of text that are worked on at a time (a longer text is taken whole).
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK + 1)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE, np.uint64))])
        _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, pow(_BASE, -1, 2**64), np.uint64))])
    return _powers, _inverse


def as_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about so many bytes."""
    raw, at = as_strings(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its hash, start and end byte; and where each text's words begin (one more entry than texts).

    ``space`` tells which bytes part words.
    """
    n = len(raw)
    solid = ~space[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = True
    np.logical_not(solid[:-1], out=before[1:])
    starts = np.flatnonzero(solid & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = True
    np.logical_not(solid[1:], out=after[:-1])
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    power, inverse = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n bytes from each place on (0 where fewer are left)."""
    power, inverse = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    out = np.zeros(len(raw), np.uint64)
    k = max(0, len(raw) - n + 1)
    out[:k] = mix((total[n : n + k] - total[:k]) * inverse[:k] + np.uint64(n))
    return out


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes of its text."""
    for _, raw, offsets in text_chunks(column):
        h, _, _, first = words(raw, offsets)
        n = len(h)
        if n == 0:
            yield from (np.zeros(0, np.uint64) for _ in range(len(offsets) - 1))
            continue
        s = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            s += h[k : k + len(s)] * _PLACE[k]
        s = mix(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:  # the whole sequence; its length keeps it apart from full shingles
                yield mix((h[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
