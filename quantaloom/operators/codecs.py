"""Vector codecs over long vectors (key, value): what is kept, what comes back, and how many bytes it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distances
from . import minmax, quantize

#: Bytes of a sparse entry as it is: an int key and a double value.
ENTRY = 12


# ---------------------------------------------------------------- fixed point

def fixed_code(value: Column, norm: Column, bits: int, round_up: Column) -> Column:
    """Sign bit and magnitude of a value against the vector's norm; ``round_up`` (0 or 1) is the rounding bit."""
    if not 1 < bits < 30:
        raise ValueError("between 2 and 29 bits")
    most = 2 ** (bits - 1) - 1
    size = F.least(F.lit(most), F.floor(F.try_divide(F.abs(value), norm) * most) + round_up)
    return F.when(value < 0, size + 2 ** (bits - 1)).otherwise(size).cast("int")


def fixed_value(code: Column, norm: Column, bits: int) -> Column:
    most, sign = 2 ** (bits - 1) - 1, 2 ** (bits - 1)
    size = code.bitwiseAND(F.lit(most)) / F.lit(float(most)) * norm
    return F.when(code.bitwiseAND(F.lit(sign)) > 0, -size).otherwise(size)


def rounding_bit(key: Column) -> Column:
    """A fixed bit for each key in place of a random one."""
    return F.pmod(F.floor(key.cast("long") * 2654435761 / 65536), F.lit(2))


def with_norm(df: DataFrame) -> DataFrame:
    norm = df.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return df.join(F.broadcast(norm))  # one row


def fixed_point(df: DataFrame, bits: int = 8) -> DataFrame:
    normed = with_norm(df)
    coded = normed.withColumn("code", fixed_code(F.col("value"), F.col("norm"), bits, rounding_bit(F.col("key"))))
    return coded.withColumn("decoded", fixed_value(F.col("code"), F.col("norm"), bits))


# ---------------------------------------------------------------- others

def as_is(df: DataFrame) -> DataFrame:
    return df.withColumn("decoded", F.col("value"))


def as_float(df: DataFrame) -> DataFrame:
    return df.withColumn("decoded", F.col("value").cast("float").cast("double"))


def quantized(df: DataFrame, kind: str = "quantile", bins: int = 256) -> DataFrame:
    q = quantize.fit(kind, df, "value", bins)
    return df.withColumn("bin", q.bin(F.col("value")).cast("int")).withColumn("decoded", q.decoded(F.col("bin")))


def sketched(df: DataFrame, kind: str = "quantile", bins: int = 256, groups: int = 8, rows: int = 2, ratio: float = 0.3) -> DataFrame:
    """(key, value, bin, restored, decoded): quantized, put into a grouped min-max sketch by key, and read back."""
    q = quantize.fit(kind, df, "value", bins)
    edges = minmax.group_edges(q.zero, q.bins, groups)
    pairs = df.withColumn("bin", q.bin(F.col("value")).cast("int")).withColumn("group", minmax.group_of(F.col("bin"), edges))
    cells, sizes = minmax.build(pairs.select("group", "key", "bin"), q.zero, rows, ratio)
    back = minmax.restore(pairs.select("group", "key"), cells, sizes, q.zero, rows).withColumnRenamed("bin", "restored")
    return pairs.join(back, ["group", "key"]).withColumn("decoded", q.decoded(F.col("restored")))


CODECS = {"none": as_is, "float": as_float, "fixed_point": fixed_point, "uniform": lambda df: quantized(df, "uniform"), "quantile": quantized, "least_squares": lambda df: quantized(df, "least_squares"), "sketch": sketched}


def run(name: str, df: DataFrame) -> DataFrame:
    if name not in CODECS:
        raise ValueError(f"codec is one of {sorted(CODECS)}")
    return CODECS[name](df)


def payload_bytes(name: str, n: int, bins: int = 256, cells: int = 0, key_bits: int = 0) -> int:
    """Bytes of a coded vector of n entries by the layout of the code, without stream overhead; keys of sparse vectors included."""
    keys, width = 4 * n, 1 if bins <= 256 else 2 if bins <= 65536 else 4
    return {
        "none": ENTRY * n, "float": 8 * n, "fixed_point": keys + n + 8, "uniform": keys + width * n + 8 * (bins - 1) + 32, "quantile": keys + width * n + 8 * (bins - 1) + 32,
        "least_squares": keys + width * n + 8 * (bins - 1) + 32, "sketch": 28 + 8 * bins + cells * width + -(-key_bits // 8),
    }[name]


def report(df: DataFrame, names: tuple[str, ...] = ("none", "float", "fixed_point", "uniform", "quantile", "least_squares", "sketch")) -> DataFrame:
    """One row for each codec: rows, distances between values and what comes back, root mean square error."""
    out = None
    for name in names:
        row = run(name, df).select("value", "decoded")
        row = distances(row, "value", "decoded").join(F.broadcast(row.agg(F.count("*").alias("n")))).select(F.lit(name).alias("codec"), "n", "squared_euclidean", "cosine", F.sqrt(F.col("squared_euclidean") / F.col("n")).alias("rmse"))
        out = row if out is None else out.unionByName(row)
    return out
