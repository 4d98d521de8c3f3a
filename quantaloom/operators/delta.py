"""Delta codes of increasing keys: gaps, bit and byte lengths, the adaptive code's cost, and payloads.

Gaps take 32 bits at most. Keys are 64 bits: a stretch of a group begins at its first key and wherever a gap would need
more, and has a base, the key without its low 32 bits, from which its first gap counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import log2_floor, needed_bytes

#: Intervals that the adaptive code may cut 32 bits into.
INTERVALS = (2, 4, 8, 16)
#: Bits that are unpacked at a time, codes and keys that are packed or passed on at a time.
BITS, CODES = 1 << 20, 1 << 16


def gaps(df: DataFrame, key: str = "key", group: str = "group") -> DataFrame:
    """Each key with the gap to the one before it in its stretch (the first: the key less the stretch's base), the gap's bits and the base.

    Groups are the unit of the code, as of the sketch that it serves; a vector is cut into as many as wanted.
    """
    w = Window.partitionBy(group).orderBy(key)
    k = F.col(key).cast("long")
    step = F.coalesce(F.try_subtract(k, F.lag(k).over(w)), F.lit(1 << 32))
    begins = step >= 1 << 32
    low = k.bitwiseAND(F.lit((1 << 32) - 1))
    base = F.last(F.when(begins, k - low), ignorenulls=True).over(w)
    gap = F.when(begins, low).otherwise(step)
    return df.select(group, key, gap.alias("gap"), base.alias("base")).withColumn("bits", F.when(F.col("gap") == 0, 1).otherwise(log2_floor(F.col("gap")) + 1).cast("int")).select(group, key, "gap", "bits", "base")


def undo(df: DataFrame, gap: str = "gap", order: str = "pos", group: str = "group") -> DataFrame:
    """Keys from gaps: a running sum in each stretch, from its base."""
    w = Window.partitionBy(group, "base").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("key", F.col("base") + F.sum(gap).over(w))


def byte_sizes(df: DataFrame) -> DataFrame:
    """Bytes of the byte-wise code in each group: two flag bits and 1, 2 or 4 bytes for each gap."""
    return df.groupBy("group").agg(F.count("*").alias("n"), F.sum(2 + 8 * needed_bytes(F.col("gap"))).cast("long").alias("total_bits"))


def adaptive_cost(df: DataFrame) -> DataFrame:
    """The expected bits of a gap in each stretch under each (intervals, flag); the unary flag costs a bit an interval.

    A gap of so many bits takes floor(bits / width) + 1 intervals in this model.
    """
    out = []
    for m in INTERVALS:
        width = 32 // m
        used = F.floor(F.col("bits") / width) + 1
        out.append(F.struct(F.lit(m).alias("intervals"), F.lit("fixed").alias("flag"), (F.avg(used) * width + (m.bit_length() - 1)).alias("cost")))
        out.append(F.struct(F.lit(m).alias("intervals"), F.lit("unary").alias("flag"), (F.avg(used) * (width + 1) + 1).alias("cost")))
    return df.groupBy("group", "base").agg(F.array(*out).alias("c")).select("group", "base", F.explode("c").alias("c")).select("group", "base", "c.*")


def choice(costs: DataFrame) -> DataFrame:
    """The cheapest way of each stretch; 32 plain bits if none is cheaper."""
    best = costs.groupBy("group", "base").agg(F.min_by(F.struct("intervals", "flag", "cost"), F.struct("cost", "intervals", "flag")).alias("b"))
    plain = F.col("b.cost") >= 32
    return best.select("group", "base", F.when(plain, 1).otherwise(F.col("b.intervals")).alias("intervals"), F.when(plain, "none").otherwise(F.col("b.flag")).alias("flag"))


def _bits(value: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The last ``length`` bits of each value, one after the other, a bit an entry."""
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(len(value)), length)
    return ((value[owner] >> (ends[owner] - 1 - np.arange(len(owner))).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


def _codes(gap: np.ndarray, bits: np.ndarray, intervals: int, flag: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, its length): the flag that tells how many intervals follow, and the gap in as many."""
    if len(gap) and (gap.min() < 0 or gap.max() >= 1 << 32):
        raise ValueError("gaps take 32 bits at most")
    width = 32 // intervals
    n = -(-bits // width)
    body = n * width
    if flag == "fixed":
        head, size = n - 1, np.full(len(n), intervals.bit_length() - 1)
    elif flag == "unary":
        head, size = (1 << n) - 2, n
    else:
        head, size = np.zeros_like(n), np.zeros_like(n)
    return head.astype(np.uint64) << body.astype(np.uint64) | gap.astype(np.uint64), size + body


def unpacked(payload: bytes, n: int, intervals: int, flag: str) -> np.ndarray:
    """The n gaps of a payload. Every bit position gets the length of the code that would begin there; the positions that
    begin codes are then found by doubling jumps."""
    raw, width, found, at = np.frombuffer(payload, np.uint8), 32 // intervals, [], 0
    head = intervals.bit_length() - 1 if flag == "fixed" else 0
    while n > 0:
        skip, first = at % 8, at // 8
        bits = np.unpackbits(raw[first : first + BITS // 8 + 16])[skip:]
        held = min(len(bits), BITS)  # codes that begin here end within the bits
        bits = np.append(bits, np.zeros(64, np.uint8))
        place = np.arange(held)
        if flag == "fixed":
            many = np.ones(held, np.int64)
            for k in range(head):
                many += bits[k : k + held].astype(np.int64) << (head - 1 - k)
            front = np.full(held, head)
        elif flag == "unary":
            stop = np.where(bits == 0, np.arange(len(bits)), len(bits) - 1)
            front = many = np.minimum.accumulate(stop[::-1])[::-1][:held] - place + 1
        else:
            many, front = np.ones(held, np.int64), np.zeros(held, np.int64)
        jump = np.append(np.minimum(place + front + many * width, held), held)
        starts, leap = np.zeros(1, np.int64), jump
        while len(starts) < n and starts[-1] < held:
            starts = np.concatenate([starts, leap[starts]])
            leap = leap[leap]
        starts = starts[starts < held][:n]
        body, value = many[starts] * width, np.zeros(len(starts), np.int64)
        begin = starts + front[starts]
        for k in range(int(body.max())):  # a bit plane at a time
            more = k < body
            value[more] = value[more] << 1 | bits[begin[more] + k]
        found.append(value)
        n -= len(starts)
        at += int(starts[-1] + front[starts[-1]] + body[-1])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _keys(stretches: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """(group, pos, key) of (group, base, start, gaps), about ``CODES`` keys a frame."""
    groups, many, pos, keys, held = [], [], [], [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"group": np.repeat(pd.Series(groups).to_numpy(), many), "pos": np.concatenate(pos), "key": np.concatenate(keys)})

    for group, base, start, gap in stretches:
        key = base + np.cumsum(gap)
        for k in range(0, len(key), CODES):
            piece = key[k : k + CODES]
            groups.append(group)
            many.append(len(piece))
            pos.append(start + np.arange(k, k + len(piece)))
            keys.append(piece)
            held += len(piece)
            if held >= CODES:
                yield frame()
                groups, many, pos, keys, held = [], [], [], [], 0
    if held:
        yield frame()


def _stretches(part: pd.DataFrame) -> Iterator[tuple]:
    """(group, base, rows) of neighbouring rows with the same group and base."""
    group, base = part["group"].to_numpy(), part["base"].to_numpy()
    ends = [*(np.flatnonzero((group[1:] != group[:-1]) | (base[1:] != base[:-1])) + 1).tolist(), len(part)]
    start = 0
    for end in ends if len(part) else ():
        yield group[start], int(base[start]), slice(start, end)
        start = end


def encode(df: DataFrame) -> DataFrame:
    """(group, base, start, intervals, flag, n, bits, payload): the adaptive code of each stretch's gaps, as bytes; ``start``
    keys of the group come before it.

    Rows of a group are packed while they stream by in key order, so a task holds bytes, not rows.
    """
    coded = df.join(choice(adaptive_cost(df)), ["group", "base"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, head, done, rest, start, n, bits, out = None, None, bytearray(), np.zeros(0, np.uint8), 0, 0, 0, []
        names = ["group", "base", "start", "intervals", "flag", "n", "bits", "payload"]
        finished = lambda: (*now, start, *head, n, bits, bytes(done) + np.packbits(rest).tobytes())
        for batch in batches:
            gap, length = batch["gap"].to_numpy(np.int64), batch["bits"].to_numpy(np.int64)
            intervals, flag = batch["intervals"].to_numpy(), batch["flag"].to_numpy()
            for group, base, own in _stretches(batch):
                if (group, base) != now:
                    if now is not None:
                        out.append(finished())
                    start = start + n if now is not None and now[0] == group else 0
                    now, head, done, rest, n, bits = (group, base), (int(intervals[own.start]), flag[own.start]), bytearray(), np.zeros(0, np.uint8), 0, 0
                value, size = _codes(gap[own], length[own], *head)
                for k in range(0, len(value), CODES):
                    fresh = np.concatenate([rest, _bits(value[k : k + CODES], size[k : k + CODES])])
                    whole = len(fresh) // 8 * 8
                    done += np.packbits(fresh[:whole]).tobytes()
                    rest = fresh[whole:]
                n, bits = n + len(value), bits + int(size.sum())
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if now is not None:
            yield pd.DataFrame([finished()], columns=names)

    kind = dict(df.dtypes)["group"]
    rows = coded.repartition("group").sortWithinPartitions("group", "base", "key").select("group", "base", "gap", "bits", "intervals", "flag")
    return rows.mapInPandas(pack, f"group {kind}, base long, start long, intervals int, flag string, n long, bits long, payload binary")


def decode(coded: DataFrame) -> DataFrame:
    """(group, pos, key) of encoded groups, each streamed out in pieces."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _keys((r.group, int(r.base), int(r.start), unpacked(r.payload, int(r.n), int(r.intervals), r.flag)) for batch in batches for r in batch.itertuples())

    return coded.mapInPandas(unpack, f"group {dict(coded.dtypes)['group']}, pos long, key long")


# ---------------------------------------------------------------- byte-wise code

#: Bytes of a gap by its two flag bits.
SIZES = np.array([1, 2, 4])


def encode_bytes(df: DataFrame) -> DataFrame:
    """(group, base, start, n, payload): two flag bits for each gap, filled up to a byte, then each gap in 1, 2 or 4 bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, start = pdf.sort_values(["base", "key"]), [], 0
        gaps = pdf["gap"].to_numpy(np.int64)
        if gaps.min() < 0 or gaps.max() >= 1 << 32:
            raise ValueError("gaps take 32 bits at most")
        for group, base, own in _stretches(pdf):
            gap = gaps[own]
            flag = (gap >= 1 << 8).astype(int) + (gap >= 1 << 16)
            flags = np.packbits(np.stack([flag >> 1, flag & 1], axis=1).ravel())
            wide = gap.astype(">u4").view(np.uint8).reshape(-1, 4)
            out.append((group, base, start, len(gap), flags.tobytes() + wide[np.arange(4) >= 4 - SIZES[flag][:, None]].tobytes()))
            start += len(gap)
        return pd.DataFrame(out, columns=["group", "base", "start", "n", "payload"])

    return df.select("group", "base", "key", "gap").groupBy("group").applyInPandas(pack, f"group {dict(df.dtypes)['group']}, base long, start long, n long, payload binary")  # a group is the unit of the code


def decode_bytes(coded: DataFrame) -> DataFrame:
    """(group, pos, key) of encoded groups."""

    def gaps_of(n: int, payload: bytes) -> np.ndarray:
        raw = np.frombuffer(payload, np.uint8)
        head = -(-2 * n // 8)
        pairs = np.unpackbits(raw[:head])[: 2 * n].reshape(-1, 2)
        size = SIZES[2 * pairs[:, 0] + pairs[:, 1]]
        wide = np.zeros((n, 4), np.uint8)
        wide[np.arange(4) >= 4 - size[:, None]] = raw[head:]
        return wide.view(">u4").ravel().astype(np.int64)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _keys((r.group, int(r.base), int(r.start), gaps_of(int(r.n), r.payload)) for batch in batches for r in batch.itertuples())

    return coded.select("group", "base", "start", "n", "payload").mapInPandas(unpack, f"group {dict(coded.dtypes)['group']}, pos long, key long")
