"""Text sources of labelled vectors: sparse pairs, dense rows, and lists of indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.losses import EPS

FORMATS = ("libsvm", "csv", "dummy")


def signed_label(y: Column, negative: bool = True) -> Column:
    """Labels other than 1 become -1."""
    return F.when(F.abs(y - 1) > EPS, F.lit(-1.0)).otherwise(y) if negative else y


def parse(lines: DataFrame, kind: str, column: str = "value", negative: bool = True) -> DataFrame:
    """(label, idx, val) of sparse lines, (label, features) of dense ones. Indices are taken as they are; blank lines go."""
    if kind not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    text = F.trim(F.col(column))
    rows = lines.where(text != "")
    parts = F.split(text, r"\s+" if kind == "libsvm" else r"\s*,\s*")
    rest = F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1))
    label = signed_label(parts[0].cast("double"), negative).alias("label")
    if kind == "csv":
        return rows.select(label, F.transform(rest, lambda p: p.cast("double")).alias("features"))
    if kind == "dummy":
        return rows.select(label, F.transform(rest, lambda p: p.cast("int")).alias("idx"), F.transform(rest, lambda p: F.lit(1.0)).alias("val"))
    return rows.select(label, F.transform(rest, lambda p: F.split(p, ":")[0].cast("int")).alias("idx"), F.transform(rest, lambda p: F.split(p, ":")[1].cast("double")).alias("val"))


def load(spark: SparkSession, path: str, kind: str, partitions: int | None = None, negative: bool = True) -> DataFrame:
    rows = parse(spark.read.text(path), kind, "value", negative)
    return rows.repartition(partitions) if partitions else rows


def save(df: DataFrame, path: str) -> None:
    """Coded columns as Parquet, with the narrow types that the codecs give them."""
    df.write.mode("errorifexists").parquet(path)


def narrow_bins(df: DataFrame, bins: int, column: str = "bin") -> DataFrame:
    """Bins as a byte, short or int, by their number."""
    return df.withColumn(column, (F.col(column) - (128 if bins <= 256 else 32768 if bins <= 65536 else 0)).cast("byte" if bins <= 256 else "short" if bins <= 65536 else "int"))


def wide_bins(df: DataFrame, bins: int, column: str = "bin") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("int") + (128 if bins <= 256 else 32768 if bins <= 65536 else 0))


def long_form(rows: DataFrame, id: str) -> DataFrame:
    """(id, key, value) of sparse rows."""
    return rows.select(id, F.explode(F.arrays_zip("idx", "val")).alias("p")).select(id, F.col("p.idx").alias("key"), F.col("p.val").alias("value"))
