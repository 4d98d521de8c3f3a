"""Exact ranks without a global sort in one task.

Equal values are counted first (with map-side combine) and kept, then dealt to buckets by approximate quantiles of the
distinct values, the more of them the more values there are; only bucket totals reach the driver. Running sums within
buckets are windows that run side by side. A value that a third of all rows have is one row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import reached
from ..sources.shared import cut

#: Distinct values of a bucket, about; buckets at most (a power of two: the driver holds a row for each).
BUCKET_VALUES, BUCKETS = 100_000, 1024


def cumulative(df: DataFrame, value: str, sums: dict[str, Column] | None = None, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """Distinct values v with n rows, n rows before them, the total n, and running sums (exclusive) of ``sums``."""
    sums = sums or {}
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items())))
    distinct, fine = counted.agg(F.count("*"), F.percentile_approx(F.col("v").cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS)).first()
    step = BUCKETS
    while step > 1 and distinct > bucket_values * (BUCKETS // step):
        step //= 2
    cuts = sorted(set((fine or [])[step - 1 :: step]))
    placed = counted.withColumn("bucket", reached(F.col("v").cast("double"), cuts) if cuts else F.lit(0))
    names = ["n", *sums]
    totals = {r["bucket"]: r for r in placed.groupBy("bucket").agg(*(F.sum(k).alias(k) for k in names)).collect()}  # at most BUCKETS rows
    offsets = {k: [0] * (len(cuts) + 2) for k in names}
    for k in names:
        for b in range(len(cuts) + 1):
            offsets[k][b + 1] = offsets[k][b] + ((totals[b][k] or 0) if b in totals else 0)
    inside = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.get(F.array(*map(F.lit, offsets[k])), F.col("bucket")) + F.coalesce(F.sum(k).over(inside), F.lit(0))).alias("before" if k == "n" else f"{k}_before") for k in names]
    return placed.select("v", "n", *sums, *before, F.lit(offsets["n"][-1]).cast("long").alias("total")).withColumn("before", F.col("before").cast("long"))


def cumulative_by(df: DataFrame, value: str, by: str, sums: dict[str, Column] | None = None, bucket_values: int = BUCKET_VALUES, name: str = "n") -> DataFrame:
    """The same within each group of ``by``, all groups in the same jobs: also ``nth``, the distinct values of the group before v. Rows are counted as ``name``.

    Rows are dealt by group and bucket; a group whose values are many has as many buckets as its share of them asks for.
    """
    sums = sums or {}
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias(name), *(F.sum(c).alias(k) for k, c in sums.items())))
    rows, cuts = counted.count(), []
    if rows > bucket_values:
        buckets = min(BUCKETS, -(-rows // bucket_values))
        cuts = sorted(set(counted.agg(F.percentile_approx(F.col("v").cast("double"), [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]))
    placed = counted.withColumns({"bucket": reached(F.col("v").cast("double"), cuts) if cuts else F.lit(0), "nth": F.lit(1).cast("long")})
    names = [name, "nth", *sums]
    held = placed.groupBy(by, "bucket").agg(*(F.sum(k).alias(k) for k in names))  # a row for each group and bucket
    earlier, whole = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(by)
    starts = held.select(by, "bucket", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_start") for k in names), F.sum(name).over(whole).alias("total"), F.sum("nth").over(whole).alias("distinct"))
    inside = Window.partitionBy(by, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.col(f"{k}_start") + F.coalesce(F.sum(k).over(inside), F.lit(0))).alias({name: "before", "nth": "nth"}.get(k, f"{k}_before")) for k in names]
    return placed.join(starts, [by, "bucket"]).select(by, "v", name, *sums, *before, "total", "distinct")


def with_splits(ranked: DataFrame, parts: int) -> DataFrame:
    """Columns a and b: the splits i = 1 .. parts - 1 from a to b have ranks floor(n i / parts), from 0, that fall on the row; none where a > b.

    They are found by division, so nothing is joined.
    """
    return ranked.withColumns({"a": F.greatest(F.expr(f"(before * {parts} + total - 1) div total"), F.lit(1)), "b": F.least(F.expr(f"((before + n) * {parts} + total - 1) div total - 1"), F.lit(parts - 1))})


def at_ranks(ranked: DataFrame, parts: int) -> DataFrame:
    """(i, rank, value) for i = 1 .. parts - 1: the value of rank floor(n i / parts), from 0."""
    return with_splits(ranked, parts).where("a <= b").select(F.explode(F.sequence("a", "b")).alias("i"), "v", "total").select("i", F.expr(f"total * i div {parts}").alias("rank"), F.col("v").alias("value"))


def at_rank(ranked: DataFrame, rank: Column) -> DataFrame:
    """The row whose value has this rank from 0."""
    return ranked.where((F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))).select(F.col("v").alias("value"))


def kth_smallest(df: DataFrame, value: str, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k counts from 1")
    return at_rank(cumulative(df, value), F.lit(k - 1))


def kth_largest(df: DataFrame, value: str, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k counts from 1")
    return at_rank(cumulative(df, value), F.col("total") - k)
