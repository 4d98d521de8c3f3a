"""Vector compressors: what is stored of a vector, and the vector back from it.

A dense vector keeps a narrow bin for each entry; a sparse one keeps, for each group of bins, a min-max sketch and the
delta-coded keys. Both keep the quantizer, which is as long as its bins. Vectors are long, (key, value). Any number of
vectors (vec, key, value) are coded in the same jobs and stored in the same tables, their quantizers as rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import sparse_add
from ..sources.shared import cut
from ..sources.text import narrow_bins, save, wide_bins
from . import delta, minmax, quantize
from .codecs import payload_bytes

#: Keys of a delta-coded stretch: stretches are coded side by side, and none is longer than this range of keys.
STRETCH = 1 << 16
#: Bits of a stretch's number, as keys have 63.
PLACES = 47


def _save_parts(spark: SparkSession, path: str, quantizer: quantize.Quantizer, rows: int, scale: float, **parts: DataFrame) -> None:
    for name, df in parts.items():
        save(df, f"{path}/{name}")
    save(spark.createDataFrame([(list(quantizer.splits), quantizer.least, quantizer.greatest, rows, scale)], "splits array<double>, least double, greatest double, rows int, scale double"), f"{path}/quantizer")


def open_vector(spark: SparkSession, path: str) -> DenseVector | SparseVector:
    """A vector that ``save`` has stored."""
    q = spark.read.parquet(f"{path}/quantizer").first()
    quantizer = quantize.Quantizer(tuple(q["splits"]), q["least"], q["greatest"])
    if not q["rows"]:
        return DenseVector(spark.read.parquet(f"{path}/entries"), quantizer, q["scale"])
    return SparseVector(*(spark.read.parquet(f"{path}/{name}") for name in ("cells", "sizes", "keys")), quantizer, q["rows"], q["scale"])


def added(*vectors: DataFrame | DenseVector | SparseVector) -> DataFrame:
    """The sum (key, value) of vectors of any kind: coded ones are decoded first, scales included."""
    plain = [v if isinstance(v, DataFrame) else v.decompress() for v in vectors]
    return reduce(sparse_add, plain)


@dataclass(frozen=True)
class DenseVector:
    """Coded entries (key, bin) in narrow bins, and what the decoded values are multiplied by."""

    entries: DataFrame
    quantizer: quantize.Quantizer
    scale: float = 1.0

    def decompress(self) -> DataFrame:
        rows = wide_bins(self.entries, self.quantizer.bins)
        return rows.select("key", (self.quantizer.decoded(F.col("bin")) * self.scale).alias("value"))

    def times(self, by: float) -> DenseVector:
        """Scales the vector without touching an entry."""
        return DenseVector(self.entries, self.quantizer, self.scale * by)

    def save(self, path: str) -> None:
        _save_parts(self.entries.sparkSession, path, self.quantizer, 0, self.scale, entries=self.entries)

    def memory_bytes(self) -> int:
        return 12 + payload_bytes("quantile", 0, self.quantizer.bins) + self.entries.count() * (1 if self.quantizer.bins <= 256 else 2 if self.quantizer.bins <= 65536 else 4)


def compress_dense(df: DataFrame, kind: str = "quantile", bins: int = 256) -> DenseVector:
    q = quantize.fit(kind, df, "value", bins)
    return DenseVector(narrow_bins(df.select("key", q.bin(F.col("value")).cast("int").alias("bin")), q.bins), q)


@dataclass(frozen=True)
class SparseVector:
    """Sketch cells by group, their sizes, and delta-coded keys by (group, stretch)."""

    cells: DataFrame
    sizes: DataFrame
    keys: DataFrame
    quantizer: quantize.Quantizer
    rows: int
    scale: float = 1.0

    def decompress(self) -> DataFrame:
        """(key, value): keys are exact; a value is never farther from the zero bin than it was."""
        keys = delta.decode(self.keys).select(F.expr(f"cast(group div {1 << PLACES} as int)").alias("group"), "key")
        back = minmax.restore(keys, self.cells, self.sizes, self.quantizer.zero, self.rows)
        return back.select("key", (self.quantizer.decoded(F.col("bin")) * self.scale).alias("value"))

    def decompress_dense(self, dim: int) -> DataFrame:
        from ..functions.vectors import dense

        return dense(self.decompress(), dim)

    def times(self, by: float) -> SparseVector:
        """Scales the vector, by a number of either sign, without touching a cell."""
        return SparseVector(self.cells, self.sizes, self.keys, self.quantizer, self.rows, self.scale * by)

    def save(self, path: str) -> None:
        _save_parts(self.cells.sparkSession, path, self.quantizer, self.rows, self.scale, cells=self.cells, sizes=self.sizes, keys=self.keys)

    def memory_bytes(self) -> int:
        n = self.cells.count()
        bits = self.keys.agg(F.coalesce(F.sum("bits"), F.lit(0)).alias("b")).first()["b"]
        return payload_bytes("sketch", 0, self.quantizer.bins, n, bits)


def compress_sparse(df: DataFrame, kind: str = "quantile", bins: int = 256, groups: int = 8, rows: int = 2, ratio: float = 0.3) -> SparseVector:
    """Keys must be different and not negative."""
    q = quantize.fit(kind, df, "value", bins)
    pairs = df.select("key", q.bin(F.col("value")).cast("int").alias("bin")).withColumn("group", minmax.group_of(F.col("bin"), minmax.group_edges(q.zero, q.bins, groups)))
    cells, sizes = minmax.build(pairs, q.zero, rows, ratio)
    stretch = F.col("group").cast("long") * (1 << PLACES) + F.expr(f"key div {STRETCH}")
    return SparseVector(cells, sizes, delta.encode(delta.gaps(pairs.select(stretch.alias("group"), "key"))), q, rows)


# ---------------------------------------------------------------- many vectors in one table

def _fitted(df: DataFrame, kind: str, bins: int) -> DataFrame:
    return cut(quantize.fit_by(kind, df, "value", "vec", bins).withColumn("scale", F.lit(1.0)))


def _decoded(rows: DataFrame, quantizers: DataFrame) -> DataFrame:
    """(vec, key, value) of (vec, key, bin)."""
    value = quantize.decoded_in(F.col("bin"), F.col("splits"), F.col("least"), F.col("greatest")) * F.col("scale")
    return rows.join(quantizers, "vec").select("vec", "key", value.alias("value"))


class _Vectors:
    """What both kinds of coded vectors do."""

    def summed(self) -> DataFrame:
        """(key, value): the sum of all vectors, scales included."""
        return self.decompress().groupBy("key").agg(F.sum("value").alias("value"))

    def save(self, path: str) -> None:
        for name in self.TABLES:
            save(getattr(self, name), f"{path}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, path: str, bins: int, **settings):
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES), bins, **settings)


@dataclass(frozen=True)
class DenseVectors(_Vectors):
    """Narrow entries (vec, key, bin), and a row for each quantizer."""

    TABLES = ("entries", "quantizers")
    entries: DataFrame
    quantizers: DataFrame
    bins: int

    def decompress(self) -> DataFrame:
        return _decoded(wide_bins(self.entries, self.bins), self.quantizers)

    def times(self, by: Column) -> DenseVectors:
        """Scales each vector by an expression of ``vec``."""
        return DenseVectors(self.entries, self.quantizers.withColumn("scale", F.col("scale") * by), self.bins)


def compress_dense_many(df: DataFrame, kind: str = "quantile", bins: int = 256) -> DenseVectors:
    q = _fitted(df, kind, bins)
    rows = df.join(q, "vec").select("vec", "key", quantize.bin_in(F.col("value"), F.col("splits"), bins).alias("bin"))
    return DenseVectors(narrow_bins(rows, bins), q, bins)


@dataclass(frozen=True)
class SparseVectors(_Vectors):
    """Cells, sizes and delta-coded keys of all vectors by (vec, group); bins count from each vector's zero bin."""

    TABLES = ("cells", "sizes", "keys", "quantizers")
    cells: DataFrame
    sizes: DataFrame
    keys: DataFrame
    quantizers: DataFrame
    bins: int
    rows: int = 2

    def decompress(self) -> DataFrame:
        names = F.split("group", "/")
        keys = delta.decode(self.keys).select(F.struct(names[0].cast("long").alias("vec"), names[1].cast("int").alias("group")).alias("group"), "key")
        both = lambda df: df.select(F.struct("vec", "group").alias("group"), *(c for c in df.columns if c not in ("vec", "group")))
        back = minmax.restore(keys, both(self.cells), both(self.sizes), 0, self.rows).select("group.vec", "key", "bin")
        zero = quantize.zero_in(F.col("splits"), F.col("least"), F.col("greatest"))
        return _decoded(back.join(self.quantizers.select("vec", zero.alias("zero")), "vec").select("vec", "key", (F.col("bin") + F.col("zero")).alias("bin")), self.quantizers)

    def times(self, by: Column) -> SparseVectors:
        """Scales each vector by an expression of ``vec``."""
        return SparseVectors(self.cells, self.sizes, self.keys, self.quantizers.withColumn("scale", F.col("scale") * by), self.bins, self.rows)


def compress_sparse_many(df: DataFrame, kind: str = "quantile", bins: int = 256, groups: int = 8, rows: int = 2, ratio: float = 0.3) -> SparseVectors:
    """Keys must be different within a vector."""
    q = _fitted(df, kind, bins)
    zero = quantize.zero_in(F.col("splits"), F.col("least"), F.col("greatest"))
    known = q.select("vec", "splits", zero.alias("zero"), minmax.group_edges_in(zero, F.size("splits") + 1, groups).alias("edges"))
    binned = df.join(known, "vec").withColumn("bin", quantize.bin_in(F.col("value"), F.col("splits"), bins))
    pairs = cut(binned.select("vec", minmax.group_of(F.col("bin"), F.col("edges")).alias("group"), "key", (F.col("bin") - F.col("zero")).alias("bin")))
    cells, sizes = minmax.build(pairs.select(F.struct("vec", "group").alias("group"), "key", "bin"), 0, rows, ratio)
    apart = lambda df: df.select("group.vec", "group.group", *(c for c in df.columns if c != "group"))
    # Only vectors of more keys than a stretch may have are cut by key: the others would fall into as many stretches as keys where these lie far apart.
    long = pairs.groupBy("vec").agg(F.count("*").alias("n")).where(F.col("n") > STRETCH).select("vec", F.lit(True).alias("long"))  # a row for each STRETCH rows at most
    stretch = F.concat_ws("/", "vec", "group", F.when(F.col("long"), F.expr(f"key div {STRETCH}")).otherwise(0))
    return SparseVectors(apart(cells), apart(sizes), delta.encode(delta.gaps(pairs.join(F.broadcast(long), "vec", "left").select(stretch.alias("group"), "key"))), q, bins, rows)
