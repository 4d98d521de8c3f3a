"""Validation of linear scores against labels of -1 and 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import cumulative


def confusion(df: DataFrame, loss: Column, score: str = "score", y: str = "y") -> DataFrame:
    """Mean loss, counts by sign (a product of 0 counts nowhere), accuracy and the recalls of either label."""
    right, positive = F.col(score) * F.col(y) > 0, F.col(y) > 0
    wrong = F.col(score) * F.col(y) < 0
    c = df.agg(
        F.avg(loss).alias("loss"), F.count("*").alias("n"), F.count_if(right & positive).alias("tp"), F.count_if(right & ~positive).alias("tn"),
        F.count_if(wrong & ~positive).alias("fp"), F.count_if(wrong & positive).alias("fn"),
    )
    return c.select("*", F.try_divide(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("true_recall"), F.try_divide("tn", F.col("tn") + F.col("fp")).alias("false_recall"))


def auc(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Area under the curve by rank sums with average ranks; null if a label is missing."""
    ranked = cumulative(df, score, {"positives": (F.col(y) > 0).cast("long")})
    average = F.col("before") + (F.col("n") + 1) / 2
    s = ranked.agg(F.sum(average * F.col("positives")).alias("ranks"), F.sum("positives").alias("p"), F.sum(F.col("n") - F.col("positives")).alias("q"))
    return s.select(F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))
