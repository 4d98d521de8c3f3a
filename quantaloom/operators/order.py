"""Order statistics of arrays and columns, and merges of sorted parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosorted(keys: Column, values: Column) -> Column:
    """Pairs of two arrays in the order of the first."""
    return F.array_sort(F.arrays_zip(keys.alias("k"), values.alias("v")))


def argmax_first(a: Column) -> Column:
    """The first place, from 0, of the greatest item."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def unique_sorted(a: Column) -> Column:
    return F.array_distinct(F.array_sort(a))


def merged(parts: list[DataFrame], key: str = "key") -> DataFrame:
    """Sorted parts as one sorted table: a union and a range-partitioned sort, whatever their number."""
    return reduce(DataFrame.unionByName, parts).orderBy(key)


def shuffled(df: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """A fixed pseudo-random order: by a seeded hash, ties by the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


#: Rounds of the bijection on places.
ROUNDS = 6


def _mixed(place: Column, half: int, seed: int) -> Column:
    """A bijection on [0, 4 ** half): each round adds a hash of one half of the bits to the other."""
    mask = F.lit((1 << half) - 1)
    pair = F.struct(F.shiftright(place, half).alias("a"), place.bitwiseAND(mask).alias("b"))
    for r in range(ROUNDS):
        step = lambda p, r=r: F.struct(p["b"].alias("a"), p["a"].bitwiseXOR(F.xxhash64(F.lit(seed * ROUNDS + r), p["b"]).bitwiseAND(mask)).alias("b"))
        pair = F.transform(F.array(pair), step)[0]
    one = F.transform(F.array(pair), lambda p: F.shiftleft(p["a"], half).bitwiseOR(p["b"]))
    return one[0]


def shuffled_places(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """``df``, whose rows are numbered 0 .. n - 1 by ``key``, with each row's place in a pseudo-random order: a bijection, so nothing is sorted or shuffled.

    Places are mixed within the next power of four; those that fall outside are mixed again until they are inside.
    """
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(160)), _mixed(F.col(key).cast("long"), half, seed), lambda p, _: F.when(p < n, p).otherwise(_mixed(p, half, seed)))
    return df.withColumn("place", F.when(again < n, again).otherwise(F.raise_error(F.lit("a place was not found"))))
