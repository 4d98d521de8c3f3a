"""Linear models that no array holds: parameters are a table (key, w, m, v) in the shared folder.

Features are joined by key. Keys that a thousandth of all features have are few; their weights are broadcast, the others meet
in a shuffle, so a feature that every row has (a bias) is no hot key. A step is a join of the table with the summed
gradient; keys that the gradient lacks stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.losses import EPS, l1_value, l2_pull, l2_value, sgd_step, truncated
from ..sources.shared import Scratch, cut
from . import glm

COLUMNS = "key long, w double, m double, v double"
#: A key is hot with one of so many features; there are no more hot keys than this.
HOT = 1024


@dataclass
class Powers:
    """Powers of Adam's decay rates."""

    b1: float = 0.9
    b2: float = 0.999


def hot_keys(rows: DataFrame) -> DataFrame:
    """(key) of the keys that at least one of ``HOT`` features have."""
    counted = cut(rows.select(F.explode(F.col("idx").cast("array<long>")).alias("key")).groupBy("key").agg(F.count("*").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return rows.sparkSession.createDataFrame([(r["key"],) for r in counted.where(F.col("n") * HOT >= total).select("key").collect()], "key long")


def adam(table: DataFrame, gradient: DataFrame, rate: float, powers: Powers) -> DataFrame:
    """The table after a step with (key, g): only keys of the gradient move."""
    met = table.join(gradient.select(F.col("key").cast("long").alias("key"), "g"), "key", "full")
    old = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in ("w", "m", "v")}
    g = F.col("g")
    stepped = met.select("key", "g", old["w"].alias("w"), F.when(g.isNull(), old["m"]).otherwise(0.9 * old["m"] + 0.1 * g).alias("m"), F.when(g.isNull(), old["v"]).otherwise(0.999 * old["v"] + 0.001 * g * g).alias("v"))
    moved = F.col("w") - rate * (1 - powers.b2) ** 0.5 * F.col("m") / ((1 - powers.b1) * (F.sqrt("v") + 1e-8))
    return stepped.select("key", F.when(g.isNull(), F.col("w")).otherwise(moved).alias("w"), "m", "v")


def sgd(table: DataFrame, gradient: DataFrame, s: glm.Settings, epoch: int) -> DataFrame:
    met = table.join(gradient.select(F.col("key").cast("long").alias("key"), "g"), "key", "full")
    w = sgd_step(F.coalesce("w", F.lit(0.0)), F.coalesce("g", F.lit(0.0)), s.learn_rate, s.learn_decay, epoch)
    return met.select("key", w.alias("w"), F.coalesce("m", F.lit(0.0)).alias("m"), F.coalesce("v", F.lit(0.0)).alias("v"))


class TableModel:
    """A model whose parameters are rows."""

    def __init__(self, spark: SparkSession, s: glm.Settings, dim: int, scratch: Scratch, hot: DataFrame):
        self.spark, self.s, self.dim, self.scratch, self.hot, self.state, self.steps = spark, s, dim, scratch, hot, Powers(), 0
        self.table = spark.createDataFrame([], COLUMNS)

    def scored(self, rows: DataFrame) -> DataFrame:
        """Rows with their score; a row's own features meet again by its number."""
        weights = self.table.select("key", "w")
        numbered = rows.withColumn("row_", F.monotonically_increasing_id()) if "id" not in rows.columns else rows.withColumn("row_", F.col("id"))
        long = numbered.select("row_", *(["worker"] if "worker" in rows.columns else []), "y", F.explode_outer(F.arrays_zip(F.col("idx").alias("k"), F.col("x").alias("x"))).alias("e"))
        long = long.select(*[c for c in long.columns if c != "e"], F.col("e.k").cast("long").alias("key"), F.col("e.x").alias("x"))
        near = long.join(F.broadcast(self.hot.join(weights, "key", "left")), "key")  # HOT rows at most
        far = long.join(F.broadcast(self.hot), "key", "left_anti").join(weights, "key", "left")
        own = [c for c in long.columns if c not in ("key", "x")]
        met = near.unionByName(far).groupBy(*own).agg(F.sum(F.col("x") * F.coalesce("w", F.lit(0.0))).alias("score"), F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "x"))).alias("f"))
        return met.select(*own, F.col("f.key").alias("idx"), F.col("f.x").alias("x"), F.coalesce("score", F.lit(0.0)).alias("score"))

    def with_l2(self, gradients: DataFrame) -> DataFrame:
        if self.s.reg_l2 <= EPS:
            return gradients
        met = gradients.join(self.table.select("key", "w"), "key", "left")
        return met.withColumn("g", F.col("g") + l2_pull(F.coalesce("w", F.lit(0.0)), self.s.reg_l2)).select(*gradients.columns)

    def penalty(self) -> float:
        r = self.table.agg(F.coalesce(l1_value(F.col("w"), self.s.reg_l1), F.lit(0.0)).alias("l1"), F.coalesce(l2_value(F.col("w"), self.s.reg_l2), F.lit(0.0)).alias("l2")).first()
        return (r["l1"] if self.s.reg_l1 > EPS else 0.0) + (r["l2"] if self.s.reg_l2 > EPS else 0.0)

    def step(self, gradient: DataFrame, epoch: int, last: bool) -> None:
        if self.s.optimizer == "sgd":
            out = sgd(self.table, gradient, self.s, epoch + last)
        else:
            if last or self.s.per_step_powers:
                self.state = Powers(self.state.b1 * 0.9, self.state.b2 * 0.999)
            out = adam(self.table, gradient, self.s.learn_rate, self.state)
        if self.s.reg_l1 > EPS:
            out = out.withColumn("w", truncated(F.col("w"), self.s.reg_l1 * self.s.learn_rate))
        self.table = self.scratch.put(out)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        self.table = spark.read.schema(COLUMNS).parquet(path)


def fit(df: DataFrame, s: glm.Settings, dim: int, path: str, id: str = "id") -> tuple[DataFrame, list[tuple]]:
    """(parameters, history) as ``glm.fit`` for sparse rows (id, y, idx, x) of ``dim`` places; weights and metrics of every epoch
    are kept in ``path``, from where the parameters are read."""
    spark = df.sparkSession
    learn, valid = glm.split(df.select(F.col(id).alias("id"), "y", "idx", "x"), "id", s.valid_ratio)
    with Scratch(spark) as scratch:
        held = glm.Held.store(glm.dealt(learn, "id", s.workers), f"{scratch.folder}/rows", s.batch_ratio)
        if not held.sizes:
            raise ValueError("no rows to learn from")
        model = TableModel(spark, s, dim, scratch, hot_keys(held.rows()))
        history = glm.train(model, held, valid, s, scratch, path)
        return spark.read.schema(COLUMNS).parquet(f"{path}/weights/{history[-1][0]}"), history
