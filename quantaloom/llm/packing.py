"""Packing of documents into as few sequences as possible, by a configuration linear program.

Texts are encoded in tasks, whole; each distinct piece of text between white space is looked up or encoded once. Only
counts by length reach the driver. There the linear program over configurations (multisets of lengths that fit a sequence)
is solved by multiplicative weights: prices start at a length's share of a sequence, a knapsack dynamic program finds the
configurations of the highest price, they are used until one of their lengths gains a step of coverage, and prices of what is
covered fall. The fractional solution is rounded down on what is left of each length, and what rounding leaves goes where it fits best.
The plan is a table of runs (length, ranks, sequences) whose size depends on lengths and configurations, never on rows.
Each piece then finds its sequence by its rank among pieces of its length. Ranks are counted in buckets of a length, so
that a length which a third of all rows have is split.

Tokens are those of the ``tokenizers`` library for vocabularies of the word-end kind (see ``bpe``); here distinct words
are merged side by side in a matrix, round by round, the lowest rank of each word first.

Defined results
  Null and empty texts: only the end token. Strings of special tokens in a text become their ids. Repeated rows and ids: a
  row each; rows without an id: packed like others. Equal lengths: any order, the same again on a rerun. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import cut

#: Tokens of a sequence; the token that ends a document.
CAPACITY, END = 2048, 0
#: Rounds of the linear program and lengths that a round covers; steps of coverage; how fast prices fall.
ROUNDS, WANTED, STEP, RATE = 60, 64, 0.5, 1.0
#: Pieces in a bucket of ranks at least, and buckets in all, about.
BUCKET, BUCKETS = 1000, 50_000
#: Bytes of text at a time, and known pieces of a Python worker at most.
TEXT, PIECES = 8_000_000, 1_000_000


# ---------------------------------------------------------------- tokens

@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, by code point."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, 3, np.uint8)
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\s+")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = k
    return out


class WordIds:
    """Ids of pieces of text between white space, filled from batch to batch."""

    def __init__(self, vocab: bpe.Vocabulary):
        self.vocab = vocab
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of words, whose bytes lie one after the other."""
        starts, order = np.cumsum(length) - length, np.argsort(length, kind="stable")
        by_length, at, parts = length[order], 0, []
        while at < len(order):  # words of like length side by side
            longest = max(int(by_length[at]) * 5 // 4, 8)
            end = min(int(np.searchsorted(by_length, longest, side="right")), at + max(1, 2_000_000 // longest))
            own = order[at:end]
            parts.append(self._matrix(_gathered(data, starts[own], length[own]), length[own]))
            at = end
        sizes, first = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        if parts:
            sizes[order] = np.concatenate([p[1] for p in parts])
            first[order] = np.cumsum(sizes[order]) - sizes[order]
        return (np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)), first, sizes

    def _matrix(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols a word a row; in each round every word's pair of the lowest rank is merged, the first of them."""
        v, wide, rows = self.vocab, int(length.max()), np.arange(len(length))
        sym = np.full((len(length), wide + 1), -1, np.int32)
        sym[np.arange(wide + 1) < length[:, None]] = v.inner[data]
        sym[rows, length - 1] = v.last[data[np.cumsum(length) - 1]]
        never = np.int32(np.iinfo(np.int32).max)
        rank = v.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(length), wide).astype(np.int32)
        rank[rank < 0] = never
        out, sizes = np.full((len(length), wide), -1, np.int32), np.zeros(len(length), np.int64)
        number, place, columns = length.copy(), rows, np.arange(wide + 1)
        while len(sym):
            at, least = np.arange(len(rank)), rank.argmin(1)
            r = rank[at, least]
            done = r == never
            if done.any():
                out[place[done], : sym.shape[1] - 1] = sym[done, :-1]
                sizes[place[done]] = number[done]
                go = ~done
                sym, rank, number, place, least, r = sym[go], rank[go], number[go], place[go], least[go], r[go]
                if not len(sym):
                    break
                at = np.arange(len(sym))
            sym[at, least] = v.made[r]
            source = columns[:-1] + (columns[:-1] > least[:, None])  # what follows the pair moves one place to the left
            sym[:, :-1] = np.take_along_axis(sym, source, 1)
            sym[:, -1] = -1
            rank[:, :-1] = np.take_along_axis(rank, source[:, :-1], 1)
            rank[:, -1] = never
            number -= 1
            for near in (least, least - 1):
                good = near >= 0
                a, x = at[good], near[good]
                fresh = v.rank(sym[a, x], sym[a, x + 1]).astype(np.int32)
                rank[a, x] = np.where(fresh < 0, never, fresh)
            most = int(number.max())
            if most + 1 < sym.shape[1] * 3 // 4:
                sym, rank, columns = sym[:, : most + 1].copy(), rank[:, :most].copy(), columns[: most + 1]
        return out[out >= 0], sizes

    def _split(self, pieces: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct words, the words of all pieces in a row by number, number of words of each piece)."""
        joined = bpe.normal("\n".join(pieces))
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind, breaks = character_classes()[codes], codes == 10
        first = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2))[: len(kind)] & ~breaks
        many = np.diff(np.concatenate([[0], np.cumsum(first)[np.flatnonzero(breaks)], [first.sum()]])).astype(np.int64)
        inside = ~breaks
        codes, first = codes[inside], first[inside]
        ends = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        offsets = np.append((np.append(0, ends[:-1])[: len(codes)])[first], ends[-1] if len(ends) else 0).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined.replace("\n", "").encode())]).dictionary_encode()
        return words.dictionary, words.indices.to_numpy(), many

    def learn(self, pieces: list[str]) -> None:
        fresh = [p for p in pieces if p not in self.known]
        if not fresh:
            return
        if len(self.known) + len(fresh) > PIECES and self.known:
            self.reset()
            fresh = pieces
        odd = [p for p in fresh if "'" in p]  # contractions
        plain = [p for p in fresh if "'" not in p] if odd else fresh
        words, number, many = self._split(plain)
        if odd:
            parts = [self.vocab.split.findall(bpe.normal(p)) for p in odd]
            more = pa.array([w for part in parts for w in part], pa.large_string()).dictionary_encode()
            number = np.concatenate([number, more.indices.to_numpy() + len(words)])
            many = np.concatenate([many, np.fromiter(map(len, parts), np.int64, len(parts))])
            words = pa.concat_arrays([words, more.dictionary])
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
        ids, starts, sizes = self.merged(data, np.diff(offsets))
        flat = _gathered(ids, starts[number], sizes[number])
        ends = np.concatenate([[0], np.cumsum(sizes[number])])
        bounds = ends[np.concatenate([[0], np.cumsum(many)])]
        self.known |= zip(plain + odd if odd else plain, range(len(self.known), len(self.known) + len(fresh)), strict=True)
        self.start = np.concatenate([self.start, len(self.flat) + bounds[:-1]])
        self.size = np.concatenate([self.size, np.diff(bounds)])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        lists = pc.utf8_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        piece = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        size = self.size[piece]
        ids = _gathered(self.flat, self.start[piece], size)
        ends = np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]
        return ids, np.diff(ends)


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """Kept by the worker from task to task."""
    return WordIds(bpe.vocabulary(path))


#: White space to one side only, or parts of special tokens: such texts take the operator's plain path.
_APART = f"[{bpe.SEPARATORS}]|<[|]"


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids of documents, their tokens with the end token) of some rows."""
    fast, plain = word_ids(path), bpe.Encoder(bpe.vocabulary(path))
    for batch in batches:
        texts = batch.column(1).fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        start = 0
        while start < len(texts):  # slices of TEXT bytes, or one row
            held = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, held + TEXT, side="right")))
            part = texts.slice(start, end - start)
            apart = pc.match_substring_regex(part, _APART).to_numpy(zero_copy_only=False)
            ids, many = fast.encode(pc.if_else(pa.array(apart), "", part) if apart.any() else part)
            ends = np.cumsum(many)
            out = []
            for i in range(end - start):
                if apart[i]:
                    row = plain.cut(part[i].as_py())
                    plain.learn([row])
                    own = plain.ids(row)[0]
                    if len(plain.pieces) > PIECES:
                        plain.reset()
                else:
                    own = ids[ends[i] - many[i] : ends[i]]
                out.append(np.append(own, END).astype("<u4"))
            yield batch.column(0).slice(start, end - start), out
            start = end


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    for ids, rows in _encoded(batches, path):
        many = [-(-len(r) // capacity) for r in rows]
        starts = [k * capacity for m in many for k in range(m)]
        pieces = [r[k * capacity : (k + 1) * capacity] for r, m in zip(rows, many, strict=True) for k in range(m)]
        yield pa.RecordBatch.from_arrays([
            ids.take(pa.array(np.repeat(np.arange(len(rows)), many))), pa.array([k for m in many for k in range(m)], pa.int32()), pa.array(starts, pa.int64()),
            pa.array([len(p) for p in pieces], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
        ], ["id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents' tokens, cut only where they are more than ``capacity``."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _cut(it, path, capacity), "id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- configurations

class Knapsack:
    """The worth of the best multiset of lengths within each room, at most ``most`` copies of each length."""

    def __init__(self, value: np.ndarray, most: np.ndarray, lengths: np.ndarray, capacity: int):
        self.lengths, self.worth, self.items, self.took = lengths, np.zeros(capacity + 1), [], []
        for i in np.argsort(-value / lengths, kind="stable").tolist():
            left, batch, l, v = int(min(most[i], capacity // lengths[i])), 1, int(lengths[i]), float(value[i])
            while left > 0:  # copies by powers of two
                c = min(batch, left)
                with_it = self.worth[: capacity + 1 - c * l] + c * v
                better = with_it > self.worth[c * l :] + 1e-12
                np.copyto(self.worth[c * l :], with_it, where=better)
                self.items.append((i, c, c * l))
                self.took.append(better)
                left, batch = left - c, 2 * batch

    def best(self, room: np.ndarray) -> np.ndarray:
        """Copies of each length in the best multiset within each of these rooms, a row a room."""
        out, at, rows = np.zeros((len(room), len(self.lengths)), np.int64), room.copy(), np.arange(len(room))
        for (i, c, size), better in zip(reversed(self.items), reversed(self.took), strict=True):
            here = rows[at >= size]
            here = here[better[at[here] - size]]
            out[here, i] += c
            at[here] -= size
        return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(configurations a row, how often): a covering of all lengths by multiplicative weights, scaled to cover each about once.

    Each round prices lengths once and takes, for each of the least covered lengths, the best configuration that holds it.
    """
    price, cover, found, often = np.ones(len(lengths)), np.zeros(len(lengths)), [], []
    for _ in range(rounds):
        sack = Knapsack(price * lengths / capacity, counts, lengths, capacity)
        wanted = np.lexsort((-lengths, cover))[:WANTED]
        config = sack.best(capacity - lengths[wanted])
        config[np.arange(len(wanted)), wanted] += 1
        config = np.unique(config[(config <= counts).all(1)], axis=0)
        if not len(config):
            break
        with np.errstate(divide="ignore"):
            use = STEP * np.where(config > 0, counts / config, np.inf).min(1)
        gained = (use[:, None] * config).sum(0) / counts
        use *= (STEP / np.maximum(gained, STEP) + np.zeros_like(config)).min(1, where=config > 0, initial=1.0)
        gained = (use[:, None] * config).sum(0) / counts
        cover += gained
        price *= np.exp(-RATE * gained)
        found.append(config)
        often.append(use)
        if cover.min() >= 1:
            break
    if not found:
        return np.zeros((0, len(lengths)), np.int64), np.zeros(0)
    scale = max(1.0, float((cover * counts * lengths).sum() / (counts * lengths).sum()))
    return np.concatenate(found), np.concatenate(often) / scale


def fitted(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, how often) of all these pieces: the longest first, each where the least room is left. Equal sequences are one row."""
    rooms: dict[int, list[list]] = {}  # room: rows of [configuration, how often]
    free: np.ndarray = np.zeros(capacity + 1, bool)
    for i in np.argsort(-lengths, kind="stable").tolist():
        l, left = int(lengths[i]), int(counts[i])
        while left:
            fit = np.flatnonzero(free[l:])
            if len(fit):
                room = l + int(fit[0])
                config, many = rooms[room].pop()
                free[room] = bool(rooms[room])
            else:
                room, config, many = capacity, {}, -(-left // (capacity // l))
            # as many copies as fit, in as many of these sequences as are filled by them
            each = min(room // l, left)
            full = min(many, left // each)
            if many > full:
                rooms.setdefault(room, []).append([config, many - full])
                if room < capacity:
                    free[room] = True
                else:
                    rooms[room].pop()  # sequences not begun
            rooms.setdefault(room - each * l, []).append([{**config, i: config.get(i, 0) + each}, full])
            free[room - each * l] = room - each * l > 0
            left -= full * each
    return [(c, n) for rows in rooms.values() for c, n in rows]


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, how often) that hold every piece once."""
    left, out = counts.astype(np.int64), []  # counts of what isn't packed yet
    if not len(lengths):
        return out
    found, often = fractional(lengths, left, capacity, rounds)
    for k in np.argsort(-often, kind="stable").tolist():
        at = np.flatnonzero(found[k])
        use = min(int(often[k]), int((left[at] // found[k][at]).min()))
        if use:
            left[at] -= use * found[k][at]
            out.append((dict(zip(at.tolist(), found[k][at].tolist(), strict=True)), use))
    rest = np.flatnonzero(left)
    return out + [({int(rest[i]): c for i, c in config.items()}, n) for config, n in fitted(lengths[rest], left[rest], capacity)]


def runs(lengths: np.ndarray, found: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Columns length, first rank, copies in a sequence, first sequence, offset: where the pieces of a length go, in order of rank."""
    rank, sequence, out = np.zeros(len(lengths), np.int64), 0, []
    for config, often in found:
        offset = 0
        for i, copies in config.items():
            out.append((int(lengths[i]), int(rank[i]), copies, sequence, offset))
            rank[i] += copies * often
            offset += copies * int(lengths[i])
        sequence += often
    table = np.array(out, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


# ---------------------------------------------------------------- ranks and places

def _ranked(cut_pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Pieces with their rank among those of their length, counted in buckets."""
    spark, keys = cut_pieces.sparkSession, ("id", "piece", "start", "ids_crc32")
    size = max(BUCKET, sum(counts.values()) // BUCKETS)
    buckets = spark.createDataFrame([(l, -(-n // size)) for l, n in counts.items()], "length long, buckets int")
    rows = cut_pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.col("buckets")).cast("int"))  # a row for each length
    held = rows.groupBy("length", "bucket").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("length").orderBy("bucket")) - F.col("held")
    offsets = held.select("length", "bucket", before.alias("before"))  # lengths and BUCKETS rows at most
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*keys)) - 1
    return rows.join(F.broadcast(offsets), ["length", "bucket"]).withColumn("rank", F.col("before") + inside).select("id", "piece", "start", "length", "ids_crc32", "rank")


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    held = cut(pieces(docs, path, id, text, capacity))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()}  # capacity rows at most
    lengths = np.array(list(counts), np.int64)
    plan = spark.sparkContext.broadcast(runs(lengths, configurations(lengths, np.array(list(counts.values()), np.int64), capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        known = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = table[np.searchsorted(known, length << 44 | rank, side="right") - 1]
            nth, copy = np.divmod(rank - run[:, 1], run[:, 2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + nth), pa.array(run[:, 4] + copy * length)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return _ranked(held, counts).mapInArrow(place, schema).withColumnRenamed("id", id)
