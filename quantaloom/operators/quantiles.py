"""Quantiles: exact by ranks, approximate and mergeable by KLL sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import at_ranks, cumulative


def check_fraction(f: float) -> float:
    if not 0 <= f <= 1:
        raise ValueError("fractions lie in [0, 1]")
    return f


def check_k(k: int) -> int:
    if not (1 <= k < 65535 and k & (k - 1) == 0):
        raise ValueError("k is a power of two below 65535")
    return k


def even_quantiles(df: DataFrame, value: str, parts: int) -> DataFrame:
    """(i, rank, value) of the parts - 1 splits into equal shares."""
    if parts <= 1:
        raise ValueError("at least two parts")
    return at_ranks(cumulative(df, value), parts)


def quantiles(df: DataFrame, value: str, fractions: Sequence[float]) -> DataFrame:
    """(fraction, value): rank floor(n f), the least for 0 and the greatest for 1."""
    wanted = F.array(*(F.lit(float(check_fraction(f))) for f in fractions))
    ranked = cumulative(df, value).withColumn("f", F.explode(wanted))
    rank = F.least(F.floor(F.col("total") * F.col("f")), F.col("total") - 1)
    return ranked.where((F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))).select(F.col("f").alias("fraction"), F.col("v").alias("value"))


def summary(df: DataFrame, value: str) -> DataFrame:
    """n, least and greatest."""
    return df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def weighted_summary(samples: DataFrame, value: str, level: str) -> DataFrame:
    """Samples of a levelled sketch: weight 2 ** level, and the weight before each value."""
    ranked = cumulative(samples, value, {"weight": F.pow(F.lit(2.0), F.col(level)).cast("long")})
    return ranked.select(F.col("v").alias("value"), "weight", F.col("weight_before").alias("before"))


def sketches(df: DataFrame, value: str, by: Sequence[str] = (), k: int = 256) -> DataFrame:
    """A mergeable sketch for each group."""
    x = F.col(value).cast("double")
    x = F.when(F.isnan(x), F.raise_error(F.lit("values must be numbers"))).otherwise(x)
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(x, F.lit(check_k(k))).alias("sketch"), F.count(value).alias("n"))


def merged_quantiles(sketched: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """(fraction, value) of merged sketches."""
    merged = sketched.agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    each = F.array(*(F.struct(F.lit(float(f)).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))).alias("value")) for f in fractions))
    return merged.select(F.explode(each).alias("r")).select("r.*")


def rank_bounds(df: DataFrame, value: str, found: DataFrame) -> DataFrame:
    """(fraction, share of rows below, share of rows up to) for found quantiles: one pass, counts only."""
    wanted = F.broadcast(found.select("fraction", F.col("value").alias("q")))  # a row for each fraction asked for
    joined = df.select(F.col(value).alias("x")).join(wanted)
    total = F.count("*")
    return joined.groupBy("fraction").agg((F.count_if(F.col("x") < F.col("q")) / total).alias("below"), (F.count_if(F.col("x") <= F.col("q")) / total).alias("upto"))


def running_sum(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums within groups."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(value).over(w))
