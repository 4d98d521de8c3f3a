"""Grouped min-max sketches over hashed keys: (key, bin) pairs are kept in a small table of cells and read back.

Cells keep, of the bins that meet in them, the one nearest to the zero bin; a query takes, over the rows, the farthest.
So a bin read back is never farther from zero than the one put in. Groups hold bins of one sign (mostly) and a narrow
range, and have tables of their own, so collisions stay within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import first_hashes, hash_by_name


def group_edges(zero: int, bins: int, groups: int = 8) -> list[int]:
    """Upper ends of the groups, the last of which is ``bins``. Groups are a span apart; the first is shifted so that the
    zero bin is an end, and is from half a span to one and a half long, or ends at zero if that comes within a span."""
    groups = max(1, min(groups, bins))
    if groups == 1:
        return [bins]
    span = bins // groups
    over = zero % span
    first = zero if groups == 2 or zero < span else over + span * (over < span // 2)
    return [first + i * span for i in range(groups - 1)] + [bins]


def group_edges_in(zero: Column, bins: Column, groups: int = 8) -> Column:
    """The same by columns of a quantizer."""
    groups = F.greatest(F.lit(1), F.least(F.lit(groups), bins))
    span = F.floor(bins / groups)
    over = zero % span
    first = F.when((groups == 2) | (zero < span), zero).otherwise(over + F.when(over < F.floor(span / 2), span).otherwise(0))
    ends = F.transform(F.sequence(F.lit(0), groups - 2), lambda i: (first + i * span).cast("int"))
    return F.when(groups == 1, F.array(bins)).otherwise(F.concat(ends, F.array(bins)))


def group_of(bin_: Column, edges: list[int] | Column) -> Column:
    """The first group whose end lies above the bin."""
    held = edges if isinstance(edges, Column) else F.array(*map(F.lit, edges))
    return F.size(F.filter(held, lambda e: e <= bin_))


def _cells(pairs: DataFrame, rows: int, sizes: DataFrame) -> DataFrame:
    """Every pair with the cell of each row, by one hash a row and the group's own size."""
    wide = pairs.join(F.broadcast(sizes), "group")  # one row for each group
    hashes = F.array(*(F.struct(F.lit(i).alias("row"), hash_by_name(n, F.col("key"), F.col("columns")).alias("cell")) for i, n in enumerate(first_hashes(rows))))
    return wide.withColumn("at", F.explode(hashes)).select("group", "key", "bin", "at.row", "at.cell")


def table_sizes(pairs: DataFrame, ratio: float = 0.3) -> DataFrame:
    return pairs.groupBy("group").agg(F.ceil(F.count("*") * F.lit(ratio)).cast("long").alias("columns"))


def build(pairs: DataFrame, zero: int, rows: int = 2, ratio: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(cells, sizes) of pairs (group, key, bin). Of two bins equally near to zero the one of the smaller key stays."""
    sizes = table_sizes(pairs, ratio)
    cells = _cells(pairs, rows, sizes).groupBy("group", "row", "cell").agg(F.min_by("bin", F.struct(F.abs(F.col("bin") - zero), F.col("key"))).alias("bin"))
    return cells, sizes


def restore(keys: DataFrame, cells: DataFrame, sizes: DataFrame, zero: int, rows: int = 2) -> DataFrame:
    """(group, key, bin) of keys (group, key): the farthest bin over the rows; the first row wins ties."""
    asked = _cells(keys.withColumn("bin", F.lit(None).cast("int")), rows, sizes).drop("bin")
    met = asked.join(cells, ["group", "row", "cell"])
    return met.groupBy("group", "key").agg(F.max_by("bin", F.struct(F.abs(F.col("bin") - zero), -F.col("row"))).alias("bin"))

