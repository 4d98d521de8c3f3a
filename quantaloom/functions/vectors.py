"""Dense vectors as arrays and sparse vectors in long form (key, value)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .losses import EPS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def constant(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


#: Numbers that are constants of a plan, at most; more are broadcast as an array, or stand in a column.
LITERALS = 4096


def reached(x: Column, splits: Sequence[float]) -> Column:
    """How many splits (sorted) x has reached: a binary search in a constant array, small code whatever the number of splits."""
    if len(splits) > LITERALS:
        return _looked_up(x, splits)
    return reached_in(x, constant(splits), len(splits))


def reached_in(x: Column, splits: Column, most: int) -> Column:
    """The same for a column of sorted arrays that hold ``most`` splits at most."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(splits, at + step - 1) <= x, at + step).otherwise(at))


def _looked_up(x: Column, splits: Sequence[float]) -> Column:
    """A search in a broadcast array, as long as the splits that the driver holds."""
    sent = SparkSession.active().sparkContext.broadcast(np.asarray(splits, float))

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, x.to_numpy(float), side="right"))

    return F.when(x.isNotNull(), place(x.cast("double")))


def item(values: Sequence[float], at: Column) -> Column:
    """The item at a place from 0; null outside."""
    if len(values) <= LITERALS:
        return F.get(constant(values), at.cast("int"))
    sent = SparkSession.active().sparkContext.broadcast(np.asarray(values, float))

    @F.pandas_udf("double")
    def held(at: pd.Series) -> pd.Series:
        inside = at.notna() & (at >= 0) & (at < len(sent.value))
        return pd.Series(np.where(inside, sent.value[at.where(inside, 0).astype(int)], np.nan)).where(inside.to_numpy())

    return held(at.cast("int"))


def sparse_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the dot product of two sparse vectors."""
    pairs = a.select("key", F.col("value").alias("x")).join(b.select("key", F.col("value").alias("y")), "key")
    return pairs.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("dot"))


def sparse_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either vector. A union and a sum: one shuffle with partial sums, where a full join would sort both sides."""
    return a.select("key", "value").unionByName(b.select("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))


def sparse(df: DataFrame, eps: float = EPS) -> DataFrame:
    return df.where(F.abs("value") > eps)


def dense(df: DataFrame, dim: int | None = None, eps: float = EPS) -> DataFrame:
    """One row for each place in [0, dim), by default up to the greatest key; absent and negligible values are 0."""
    if dim is None:
        dim = df.agg(F.coalesce(F.max("key") + 1, F.lit(0))).first()[0]
    places = df.sparkSession.range(dim).select(F.col("id").alias("key"))
    return places.join(sparse(df, eps), "key", "left").select("key", F.coalesce("value", F.lit(0.0)).alias("value"))


def format_choice(df: DataFrame, dim: Column | int, eps: float = EPS) -> DataFrame:
    """nnz, dim, and 'dense' if more than two thirds of the places (rounded down) are filled, else 'sparse'."""
    dim = F.lit(dim).cast("long") if isinstance(dim, int) else dim
    counted = df.agg(F.count_if(F.abs("value") > eps).alias("nnz"), F.max(dim).alias("dim"))
    return counted.select("nnz", "dim", F.when(F.col("nnz") > F.floor(F.col("dim") * 2 / 3), "dense").otherwise("sparse").alias("format"))


def scaled(df: DataFrame, by: float) -> DataFrame:
    return df.withColumn("value", F.col("value") * F.lit(by))


def distances(df: DataFrame, a: str, b: str) -> DataFrame:
    """Squared and plain Euclidean distance and cosine of two value columns."""
    d = F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    dots = F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) * F.col(a)), F.sum(F.col(b) * F.col(b))
    return df.agg(d.alias("squared_euclidean"), F.sqrt(d).alias("euclidean"), F.try_divide(dots[0], F.sqrt(dots[1]) * F.sqrt(dots[2])).alias("cosine"))


def norms(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(F.abs("value")).alias("l1"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2"))
