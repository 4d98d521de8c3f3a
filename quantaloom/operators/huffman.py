"""Huffman codes of integers, for any number of distinct values.

Lengths come from a row for each distinct count, with how many values have it: equal weights are paired in one go, so the
driver's work grows with the number of different counts, not of values. Codes are canonical: those of a length are
consecutive numbers, so a value's code is its rank among the values of its count plus an offset, found in Spark, and a
stream of codes is cut by comparing numbers. Tables of few values are kept by the driver and broadcast; longer ones stay
tables and meet in joins.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import delta, ranks

#: Distinct values of a code that the driver holds, at most.
MOST_SYMBOLS = 1 << 16
#: Rows of different counts that are constants of a join's small side, at most; beyond, it is shuffled.
BROADCAST = 1 << 20


def counts(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def lengths(counted: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """By count, (length, how many values have it), of (count, how many values have it). One value alone takes one bit."""
    heap = [(n, i, m) for i, (n, m) in enumerate(sorted(counted))]
    leaves, below = [n for n, _, _ in heap], [[] for _ in heap]  # below: of each kind of node, the kinds it joins, and how many of each
    if sum(m for _, _, m in heap) == 1:
        return {leaves[0]: [(1, 1)]}
    while len(heap) > 1 or heap and heap[0][2] > 1:
        n, i, m = heapq.heappop(heap)
        if m > 1:  # all of them pair up, but for one of an odd number
            heapq.heappush(heap, (2 * n, len(below), m // 2))
            below.append([(i, 2)])
            if m % 2:
                heapq.heappush(heap, (n, i, 1))
        else:
            other, j, k = heapq.heappop(heap)
            heapq.heappush(heap, (n + other, len(below), 1))
            below.append([(i, 1), (j, 1)])
            if k > 1:
                heapq.heappush(heap, (other, j, k - 1))
    depths = [Counter() for _ in below]
    if depths:
        depths[-1][0] = 1
    for i in reversed(range(len(leaves), len(below))):
        for j, each in below[i]:
            for depth, k in depths[i].items():
                depths[j][depth + 1] += each * k
    return {n: sorted(depths[i].items()) for i, n in enumerate(leaves)}


class Code:
    """Built by ``fit``: first code and first rank of each length, and a table of (value, n, length, index), a value's place among all codes."""

    def __init__(self, counted: list[tuple[int, int]], table: DataFrame | None = None):
        """``counted``: (value, count) of all values; or, with a table (value, n, nth in its count), (count, how many values have it)."""
        groups = counted if table is not None else list(Counter(n for _, n in counted).items())
        self.long = table is not None
        by_count = lengths(groups)
        many = Counter()
        for own in by_count.values():
            for length, m in own:
                many[length] += m
        self.lengths = sorted(many)
        self.first, self.base, code, index, last = {}, {}, 0, 0, 0
        for length in self.lengths:
            code <<= length - last
            self.first[length], self.base[length], last = code, index, length
            code, index = code + many[length], index + many[length]
        self.many = many
        # of each count: from which rank on values have which length, and the place of the first of them
        self.parts, at = [], dict(self.base)
        for n in sorted(by_count):
            rank = 0
            for length, m in by_count[n]:
                self.parts.append((n, rank, rank + m, length, at[length] - rank))
                at[length] += m
                rank += m
        self.values, self.bits, self.table = np.zeros(0, np.int64), {}, None
        if self.long:
            self.table = self._placed(table)
            return
        held = pd.DataFrame(sorted(counted, key=lambda c: (c[1], c[0])), columns=["value", "n"])
        held["nth"] = held.groupby("n").cumcount() if len(held) else []
        parts, self.values = {}, np.zeros(len(held), np.int64)
        for n, a, b, length, shift in self.parts:
            parts.setdefault(n, []).append((b, length, shift))
        for value, n, nth in held.itertuples(index=False):
            length, shift = next((length, shift) for b, length, shift in parts[n] if nth < b)
            index = nth + shift
            self.values[index] = value
            self.bits[int(value)] = f"{self.first[length] + index - self.base[length]:0{length}b}"

    def _placed(self, ranked: DataFrame) -> DataFrame:
        parts = ranked.sparkSession.createDataFrame(self.parts, "n long, from_ long, to_ long, length int, shift long")
        parts = F.broadcast(parts) if len(self.parts) <= BROADCAST else parts  # a row for each count and length
        met = ranked.join(parts, "n").where((F.col("nth") >= F.col("from_")) & (F.col("nth") < F.col("to_")))
        first = F.create_map(*(F.lit(x) for length in self.lengths for x in (length, self.first[length] - self.base[length])))
        index = F.col("nth") + F.col("shift")
        bits = F.expr("lpad(bin(number), length, '0')")
        return met.withColumn("index", index).withColumn("number", (F.col("index") + first[F.col("length")]).cast("long")).select("value", "index", bits.alias("code"))

    def of(self, spark: SparkSession) -> DataFrame:
        """(value, code) of all values."""
        if self.long:
            return self.table.select("value", "code")
        return F.broadcast(spark.createDataFrame([(v, b) for v, b in self.bits.items()], "value long, code string"))  # MOST_SYMBOLS rows at most


def fit(df: DataFrame, value: str, most: int | None = None) -> Code:
    """The driver holds codes of at most ``most`` values (``MOST_SYMBOLS``)."""
    counted = cut(counts(df, value))
    if counted.count() <= (MOST_SYMBOLS if most is None else most):
        return Code([(r["value"], r["n"]) for r in counted.collect()])
    groups = [(r["n"], r["m"]) for r in counted.groupBy("n").agg(F.count("*").alias("m")).collect()]  # a row for each different count
    ranked = ranks.cumulative_by(counted, "value", "n", name="m").select(F.col("v").alias("value"), "n", "nth")
    return Code(groups, cut(ranked))


def encode(df: DataFrame, value: str, code: Code) -> DataFrame:
    """``df`` with the bits of each value."""
    return df.join(code.of(df.sparkSession).withColumnRenamed("value", "value_"), F.col(value) == F.col("value_")).drop("value_")


def decode(encoded: DataFrame, code: Code) -> DataFrame:
    table = code.of(encoded.sparkSession).select(F.col("value").alias("decoded"), F.col("code").alias("code_"))
    return encoded.join(F.broadcast(table) if not code.long else table, F.col("code") == F.col("code_")).drop("code_")


def total_bits(df: DataFrame, value: str, code: Code) -> DataFrame:
    return encode(df, value, code).agg(F.sum(F.length("code")).cast("long").alias("total_bits"), F.count("*").alias("n"))


def pack(df: DataFrame, group: str, order: str, value: str, code: Code) -> DataFrame:
    """(group, n, bits, payload): each group's codes one after the other, as bytes; a group is the unit of the code."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, value])
        length = pdf["length"].to_numpy(np.int64)
        bits = delta._bits(pdf["number"].to_numpy(np.int64).astype(np.uint64), length)
        return pd.DataFrame({group: pdf[group].iloc[:1], "n": [len(pdf)], "bits": [len(bits)], "payload": [np.packbits(bits).tobytes()]})

    rows = encode(df, value, code).select(group, order, value, F.length("code").alias("length"), F.conv("code", 2, 10).cast("long").alias("number"))
    return rows.groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, n long, bits long, payload binary")


def _cut_up(payload: bytes, bits: int, firsts: list[tuple[int, int, int, int]]) -> Iterator[np.ndarray]:
    """Places among all codes, of a stream. Every bit position gets the length of the code that would begin there, by its next 64 bits; jumps are then doubled."""
    size, first, many, base = (np.array(c, np.uint64) for c in zip(*firsts, strict=True))
    ends = np.array([(int(f) + int(m)) << (64 - int(s)) for s, f, m in zip(size, first, many, strict=True)][:-1], np.uint64)
    raw, at = np.frombuffer(payload, np.uint8), 0
    while at < bits:
        skip, begin = at % 8, at // 8
        part = np.append(raw[begin : begin + delta.BITS // 8 + 9], np.zeros(16, np.uint8))
        held = min(8 * (len(part) - 16) - skip, bits - at, delta.BITS)
        wide = np.zeros(held // 8 + 2, np.uint64)
        for k in range(8):
            wide = wide << np.uint64(8) | part[k : k + len(wide)]
        place = np.arange(held) + skip
        low = (place % 8).astype(np.uint64)
        next_ = part[place // 8 + 8].astype(np.uint64)
        window = wide[place // 8] << low | next_ >> (np.uint64(8) - low)
        kind = np.searchsorted(ends, window, side="right")
        jump = np.append(np.minimum(np.arange(held) + size[kind].astype(np.int64), held), held)
        starts, leap = np.zeros(1, np.int64), jump
        while starts[-1] < held:
            starts = np.concatenate([starts, leap[starts]])
            leap = leap[leap]
        starts = starts[starts < held]
        kinds = kind[starts]
        if at + held < bits:  # the last code may go on behind
            starts, kinds = starts[:-1], kinds[:-1]
        yield (base[kinds] + (window[starts] >> (np.uint64(64) - size[kinds])) - first[kinds]).astype(np.int64)
        at += int(starts[-1] + size[kinds[-1]].astype(np.int64))


def unpack(packed: DataFrame, group: str, code: Code) -> DataFrame:
    """(group, pos, value) of packed groups, each streamed out in pieces."""
    firsts = [(length, code.first[length], code.many[length], code.base[length]) for length in code.lengths]
    values = None if code.long else code.values

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, bits, payload in zip(batch[group], batch["bits"], batch["payload"], strict=True):
                pos = 0
                for found in _cut_up(payload, int(bits), firsts) if bits else ():
                    yield pd.DataFrame({group: [key] * len(found), "pos": np.arange(pos, pos + len(found)), "value": found if values is None else values[found]})
                    pos += len(found)

    out = packed.select(group, "bits", "payload").mapInPandas(run, f"{group} {dict(packed.dtypes)[group]}, pos long, value long")
    if not code.long:
        return out
    return out.withColumnRenamed("value", "index").join(code.table.select("index", "value"), "index").select(group, "pos", "value")
