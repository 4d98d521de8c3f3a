"""Bit arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_floor(x: Column) -> Column:
    """Exact for positive integers; null for others."""
    return F.when(x > 0, F.length(F.bin(x.cast("long"))) - 1).cast("int")


def is_power_of_two(x: Column, most: int = 32768) -> Column:
    return (F.bit_count(x) == 1) & x.between(1, most)


def needed_bytes(x: Column) -> Column:
    return F.when(x < 0, F.lit(None)).when(x < 256, 1).when(x < 65536, 2).otherwise(4).cast("int")


def bits_of(x: Column, width: int) -> Column:
    """Most significant bit first."""
    return F.lpad(F.bin(x.cast("long")), width, "0")


def number_of(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("long")
