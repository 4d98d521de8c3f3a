"""Quantizers: splits fitted to values, bins, and bin midpoints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import item, reached, reached_in
from ..sources.shared import Scratch, cut
from .ranks import cumulative, cumulative_by, with_splits

#: Intervals of a group that one task merges, at most; longer tables are merged round by round on all tasks.
LOCAL = 1 << 17
#: Pairs among which the worst are looked for at a time.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Quantizer:
    """Splits between bins (sorted), the range, and the bin of zero. As large as the number of bins, not as the data."""

    splits: tuple[float, ...]
    least: float
    greatest: float

    @property
    def bins(self) -> int:
        return len(self.splits) + 1

    @property
    def zero(self) -> int:
        if self.least > 0:
            return 0
        return self.bins - 1 if self.greatest < 0 else sum(s < 0 for s in self.splits)

    @property
    def values(self) -> tuple[float, ...]:
        """Midpoints of the bins."""
        edges = (self.least, *self.splits, self.greatest)
        return tuple(0.5 * (a + b) for a, b in zip(edges[:-1], edges[1:], strict=True))

    def bin(self, x: Column) -> Column:
        """The number of splits that x has reached."""
        if not self.splits:
            return F.when(x.isNotNull(), F.lit(0))
        return F.when(x.isNotNull(), reached(x.cast("double"), self.splits))

    def decoded(self, bin_: Column) -> Column:
        return item(self.values, bin_)

    def times(self, by: float) -> Quantizer:
        return Quantizer(tuple(s * by for s in self.splits), self.least * by, self.greatest * by)


def _range(df: DataFrame, value: str) -> tuple[float, float]:
    r = df.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count_if(F.isnan(F.col(value).cast("double"))).alias("nan")).first()
    if r["nan"]:
        raise ValueError("values must be numbers")
    if r["a"] is None:
        raise ValueError("no values")
    return float(r["a"]), float(r["b"])


def uniform(df: DataFrame, value: str, bins: int = 256) -> Quantizer:
    """Equal steps from the least to the greatest."""
    a, b = _range(df, value)
    return Quantizer(tuple(a + (b - a) / bins * i for i in range(1, bins)), a, b)


def quantile(df: DataFrame, value: str, bins: int = 256) -> Quantizer:
    """Equal shares of rows; equal splits count once, so there may be fewer bins."""
    return _one(_limits(with_splits(cumulative(df, value), _parts(bins))).first())


def _parts(bins: int) -> int:
    if bins <= 1:
        raise ValueError("at least two bins")
    return bins


def _limits(ranked: DataFrame, *by: str) -> DataFrame:
    """Distinct splits (at most as many as bins), least and greatest, of each group."""
    v = F.col("v").cast("double")
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_set(F.when(F.col("a") <= F.col("b"), v))).alias("splits"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def _one(r) -> Quantizer:
    if r is None or r["least"] is None:
        raise ValueError("no values")
    if r["greatest"] != r["greatest"]:  # NaN sorts last
        raise ValueError("values must be numbers")
    return Quantizer(tuple(r["splits"]), r["least"], r["greatest"])


def least_squares(df: DataFrame, value: str, bins: int = 256) -> Quantizer:
    """Neighbouring intervals are merged, those first that add least squared error, until at most ``bins`` are left.

    Intervals start as single values, equal ones as one. Each round pairs neighbours and keeps pairs apart that are among the worst;
    if a round brings nothing, the least pair is merged all the same.
    """
    a, b = _range(df, value)
    found = _least_squares_by(df.select(F.lit(0).alias("group_"), F.col(value).alias("value_")), "value_", "group_", bins).first()
    return Quantizer(tuple(found["splits"]), a, b)


# ---------------------------------------------------------------- many vectors in the same jobs

def merged_lows(n: np.ndarray, s: np.ndarray, q: np.ndarray, low: np.ndarray, bins: int) -> np.ndarray:
    """The least values of what is left of neighbouring intervals (rows, sum, sum of squares, least value), merged until at most ``bins`` are left."""
    parts = [n.astype(float), s, q, low]
    while len(parts[0]) > bins:
        size = len(parts[0])
        half = size // 2
        left, right = ([p[k : 2 * half : 2] for p in parts] for k in (0, 1))
        n, s, q = (a + b for a, b in zip(left[:3], right[:3], strict=True))
        apart = max(0, min(bins // 2 - size % 2, half - 1))
        keep = np.zeros(half, bool)
        keep[np.argsort(-(q - s * s / n), kind="stable")[:apart]] = True
        first = np.arange(half) + np.cumsum(keep) - keep
        out = []
        for k, p in enumerate(parts):
            new = np.empty(half + int(keep.sum()) + size % 2, p.dtype)
            new[first] = np.where(keep, left[k], (n, s, q, left[3])[k])
            new[first[keep] + 1] = right[k][keep]
            new[len(new) - size % 2 :] = p[2 * half :]
            out.append(new)
        parts = out
    return parts[3]


def _merge_round(parts: DataFrame, by: str, bins: int) -> DataFrame:
    """One round on tables (by, i, n, s, q, low) of any length: pairs side by side, the worst by ranks in chunks first, new places by counting."""
    size = parts.groupBy(by).agg(F.count("*").alias("size"))
    own = F.struct("n", "s", "q", "low")
    pairs = parts.join(size, by).withColumn("pair", F.expr("i div 2")).groupBy(by, "pair").agg(F.max("size").alias("size"), F.count("*").alias("m"), F.min_by(own, "i").alias("x"), F.max_by(own, "i").alias("y"))
    n, s, q = (F.col(f"x.{k}") + F.col(f"y.{k}") for k in ("n", "s", "q"))
    pairs = pairs.withColumns({"both": F.struct(n.alias("n"), s.alias("s"), q.alias("q"), F.col("x.low").alias("low")), "error": q - s * s / n})
    apart = F.greatest(F.lit(0), F.least(F.lit(bins // 2) - F.col("size") % 2, F.expr("size div 2") - 1))
    worst = pairs.where((F.col("m") == 2) & (F.col("size") > bins)).select(by, "pair", "error", apart.alias("apart"))
    for keys in ([by, F.expr(f"pair div {CHUNK}")], [by]):
        order = Window.partitionBy(*keys).orderBy(F.col("error").desc(), "pair")
        worst = worst.withColumn("rank", F.row_number().over(order)).where(f"rank <= {max(1, bins // 2)} and rank <= apart")
    worst = worst.groupBy(by).agg(F.sort_array(F.collect_list("pair")).alias("worst"))  # half as many as bins at most
    rows = pairs.join(worst, by, "left").withColumn("worst", F.coalesce("worst", F.array().cast("array<bigint>")))
    upto = [reached_in(F.col("pair") - k, F.col("worst"), bins) for k in (0, 1)]
    done = F.col("size") <= bins
    kept = (F.col("m") == 2) & (done | (upto[0] > upto[1]))
    place = F.when(done, 2 * F.col("pair")).otherwise(F.col("pair") + upto[1])
    each = F.when(kept, F.array(F.struct(place.alias("i"), F.col("x").alias("p")), F.struct((place + 1).alias("i"), F.col("y").alias("p"))))
    each = each.otherwise(F.array(F.struct(place.alias("i"), F.when(F.col("m") == 1, F.col("x")).otherwise(F.col("both")).alias("p"))))
    return rows.select(by, F.explode(each).alias("e")).select(by, "e.i", "e.p.n", "e.p.s", "e.p.q", "e.p.low")


def _least_squares_by(df: DataFrame, value: str, by: str, bins: int) -> DataFrame:
    """(by, splits)."""
    ranked = cumulative_by(df.withColumn("v_", F.col(value).cast("double")), "v_", by)
    n, v = F.col("n").cast("double"), F.col("v")
    parts = ranked.select(by, F.col("nth").cast("long").alias("i"), n.alias("n"), (n * v).alias("s"), (n * v * v).alias("q"), v.alias("low"), "distinct")
    longest = parts.agg(F.max("distinct")).first()[0] or 0
    parts = parts.drop("distinct")
    kind = dict(df.dtypes)[by]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        low = merged_lows(*(pdf[k].to_numpy(float) for k in ("n", "s", "q", "low")), bins)
        return pd.DataFrame({by: pdf[by].iloc[:1], "splits": [np.unique(low[1:])]})

    last = lambda parts: parts.groupBy(by).applyInPandas(finish, f"{by} {kind}, splits array<double>")
    if longest <= LOCAL:
        return last(parts)
    with Scratch(df.sparkSession) as scratch:
        parts = scratch.put(parts)
        while longest > LOCAL:
            parts = scratch.replace(_merge_round(parts, by, bins))
            longest = parts.groupBy(by).count().agg(F.max("count")).first()[0]
        return cut(last(parts))


def fit_by(kind: str, df: DataFrame, value: str, by: str, bins: int = 256) -> DataFrame:
    """(by, splits array<double>, least, greatest): the quantizer of each group's values, all in the same jobs."""
    if kind not in FITS:
        raise ValueError(f"quantizer is one of {sorted(FITS)}")
    if kind == "quantile":
        return _limits(with_splits(cumulative_by(df, value, by), _parts(bins)), by)
    x = F.col(value).cast("double")
    range_ = df.where(x.isNotNull()).groupBy(by).agg(F.min(x).alias("least"), F.max(x).alias("greatest"))
    if kind == "least_squares":
        return range_.join(_least_squares_by(df, value, by, bins), by).select(by, "splits", "least", "greatest")
    step = (F.col("greatest") - F.col("least")) / bins
    splits = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("least") + step * i) if bins > 1 else F.array().cast("array<double>")
    return range_.select(by, splits.alias("splits"), "least", "greatest")


def bin_in(x: Column, splits: Column, bins: int) -> Column:
    """The bin by a column of splits, fewer than ``bins``."""
    return F.when(x.isNotNull(), reached_in(x.cast("double"), splits, bins))


def decoded_in(bin_: Column, splits: Column, least: Column, greatest: Column) -> Column:
    """The midpoint of a bin by columns of a quantizer."""
    edge = lambda i: F.when(i <= 0, least).when(i > F.size(splits), greatest).otherwise(F.get(splits, i - 1))
    return F.lit(0.5) * (edge(bin_) + edge(bin_ + 1))


def zero_in(splits: Column, least: Column, greatest: Column) -> Column:
    """The bin of zero by columns of a quantizer."""
    return F.when(least > 0, 0).when(greatest < 0, F.size(splits)).otherwise(F.size(F.filter(splits, lambda s: s < 0)))


def prefix_sums(df: DataFrame, value: str) -> DataFrame:
    """Sums of x and x squared up to and with each distinct value."""
    x = F.col(value).cast("double")
    ranked = cumulative(df, value, {"s": x, "q": x * x})
    return ranked.select(F.col("v").alias("value"), (F.col("before") + F.col("n")).alias("rows"), (F.col("s_before") + F.col("s")).alias("sum1"), (F.col("q_before") + F.col("q")).alias("sum2"))


FITS = {"uniform": uniform, "quantile": quantile, "least_squares": least_squares}


def fit(kind: str, df: DataFrame, value: str, bins: int = 256) -> Quantizer:
    if kind not in FITS:
        raise ValueError(f"quantizer is one of {sorted(FITS)}")
    return FITS[kind](df, value, bins)
