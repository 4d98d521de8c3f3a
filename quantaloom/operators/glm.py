"""Generalized linear models by mini-batches over workers, with coded gradients.

Rows are (worker, pos, y, x array<double>), or with idx array<int> the entries x of a sparse vector. They are stored once by
ranges of positions, and a batch, a circular range of positions in each worker, reads its ranges alone. Scores are array
expressions against weights in the plan (a model is as long as a row), or joins with a table of weights (see ``params``).
Gradients and losses are sums by (worker, key) with partial aggregation, one pass over a batch; all workers' gradients go
through the codec in the same jobs, and the decoded ones are summed. Metrics and weights can be kept from epoch to epoch, and
a run goes on from the last one kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.losses import EPS, LOSSES, l2_pull, sgd_rate
from ..functions.vectors import constant, dot, reached
from ..sources.shared import Scratch, cut
from . import codecs, metrics, minmax, quantize


@dataclass(frozen=True)
class Settings:
    """Defaults of a run; names follow the usual configuration keys."""

    algo: str = "logistic"
    workers: int = 4
    valid_ratio: float = 0.25
    epochs: int = 5
    batch_ratio: float = 0.1
    learn_rate: float = 0.1
    learn_decay: float = 0.9
    reg_l1: float = 0.0
    reg_l2: float = 0.1
    codec: str = "none"
    bins: int = 256
    bits: int = 8
    groups: int = 8
    rows: int = 2
    ratio: float = 0.3
    optimizer: str = "adam"
    per_step_powers: bool = False
    seed: int = 7

    def __post_init__(self):
        if self.algo not in LOSSES:
            raise ValueError(f"algo is one of {sorted(LOSSES)}")
        if self.codec not in CODECS:
            raise ValueError(f"codec is one of {sorted(CODECS)}")
        if self.optimizer not in ("adam", "sgd"):
            raise ValueError("optimizer is adam or sgd")

    @classmethod
    def from_conf(cls, spark, prefix: str = "spark.quantaloom.") -> Settings:
        """Settings from the session: ``<prefix><field>``, as text; fields that aren't set keep their defaults."""
        found = {}
        for name, default in ((f.name, f.default) for f in fields(cls)):
            value = spark.conf.get(prefix + name, None)
            if value is not None:
                found[name] = value.lower() == "true" if isinstance(default, bool) else type(default)(value)
        return cls(**found)

    @property
    def batches(self) -> int:
        return int(np.ceil(1 / self.batch_ratio))


#: Codecs of gradients.
CODECS = ("none", "float", "fixed_point", "quantile", "uniform", "least_squares", "sketch")


# ---------------------------------------------------------------- data

#: Ranges of ids at most, and rows of a worker in one of them, about.
RANGES, RANGE_ROWS = 1024, 100_000
#: Weights that are constants of a plan, at most; longer models are broadcast as arrays.
LITERALS = 4096
#: Stretches of positions that a batch covers, about, and rows of a worker's stretch at most.
STRETCHES, STRETCH_ROWS = 4, 1_000_000


def dealt(df: DataFrame, id: str, workers: int) -> DataFrame:
    """Rows with their worker and place in it; the worker's rows are ordered by id.

    Places are counted within ranges of ids, which run side by side, and start at the number of the worker's rows before.
    """
    n, fine = df.agg(F.count("*"), F.percentile_approx(F.col(id).cast("double"), [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()
    step = RANGES
    while step > 1 and n > RANGE_ROWS * workers * (RANGES // step):
        step //= 2
    cuts = sorted(set((fine or [])[step - 1 :: step]))
    rows = df.withColumn("worker", F.pmod(F.col(id), F.lit(workers)).cast("int")).withColumn("range_", reached(F.col(id).cast("double"), cuts) if cuts else F.lit(0))
    held = rows.groupBy("worker", "range_").agg(F.count("*").alias("held_"))  # a row for each worker and range
    by = Window.partitionBy("worker")
    starts = held.withColumn("before_", F.sum("held_").over(by.orderBy("range_")) - F.col("held_")).withColumn("size", F.sum("held_").over(by)).drop("held_")
    place = F.row_number().over(Window.partitionBy("worker", "range_").orderBy(id)) - 1
    return rows.join(F.broadcast(starts), ["worker", "range_"]).withColumn("pos", F.col("before_") + place).select(*df.columns, "worker", "pos", "size")


def batch(rows: DataFrame, b: int, ratio: float) -> DataFrame:
    """The rows that the b-th circular read of each worker takes: int(size * ratio) of them."""
    per = F.floor(F.col("size") * F.lit(ratio)).cast("long")
    return rows.withColumn("per", per).where(F.col("per") > 0).where(F.pmod(F.col("pos") - F.lit(b) * F.col("per"), F.col("size")) < F.col("per"))


class Held:
    """Rows stored by worker and stretch of positions; a batch reads the stretches that it touches."""

    def __init__(self, spark: SparkSession, path: str, kinds: StructType, width: int, sizes: dict[int, int]):
        self.spark, self.width, self.sizes = spark, width, sizes
        self._rows = spark.read.schema(kinds).parquet(path)  # files are listed once

    @classmethod
    def store(cls, rows: DataFrame, path: str, ratio: float) -> Held:
        """``rows`` as ``dealt`` gives them."""
        spark = rows.sparkSession
        longest = rows.agg(F.max("size")).first()[0] or 0
        width = max(1, min(STRETCH_ROWS, int(longest * ratio) // STRETCHES))
        placed = rows.withColumn("stretch", F.expr(f"pos div {width}").cast("int"))
        placed.repartition("worker", "stretch").sortWithinPartitions("worker", "stretch", "pos").write.partitionBy("worker", "stretch").parquet(path)
        found = cls(spark, path, placed.schema, width, {})
        found.sizes = {r["worker"]: r["size"] for r in found.rows().groupBy("worker").agg(F.max("size").alias("size")).collect()}  # a row for each worker
        return found

    def rows(self) -> DataFrame:
        return self._rows

    def batch(self, b: int, ratio: float) -> DataFrame:
        """The same rows as ``batch`` of all of them."""
        wanted: dict[tuple[int, ...], list[int]] = {}
        for worker, size in self.sizes.items():
            per = int(size * ratio)
            start, touched = (b * per) % size, set()
            for first, last in ((start, min(start + per, size)), (0, start + per - size)):
                touched |= set(range(first // self.width, (last - 1) // self.width + 1)) if last > first else set()
            wanted.setdefault(tuple(sorted(touched)), []).append(worker)
        read = F.lit(False)
        for stretches, workers in wanted.items():
            if stretches:
                read = read | (F.col("worker").isin(workers) & F.col("stretch").isin(list(stretches)))
        return batch(self.rows().where(read), b, ratio)


def split(df: DataFrame, id: str, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(train, valid) by a fixed hash of the id, in thousandths."""
    slot = F.pmod(F.col(id).cast("long") * 7919, F.lit(1000))
    return df.where(slot >= int(ratio * 1000)), df.where(slot < int(ratio * 1000))


# ---------------------------------------------------------------- one step

def _scored_by_array(rows: DataFrame, weights) -> DataFrame:
    """For models too long for a plan: a broadcast array, as long as what the driver holds."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(weights, float))

    @F.pandas_udf("double")
    def dense(x: pd.Series) -> pd.Series:
        return x.map(lambda v: float(np.dot(np.asarray(v, float), sent.value[: len(v)]))).astype(float)

    @F.pandas_udf("double")
    def sparse(idx: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([float(np.dot(sent.value[np.asarray(i, int)], np.asarray(v, float))) for i, v in zip(idx, x, strict=True)], dtype=float)

    return rows.withColumn("score", sparse("idx", "x") if "idx" in rows.columns else dense("x"))


def scored(rows: DataFrame, weights) -> DataFrame:
    if len(weights) > LITERALS:
        return _scored_by_array(rows, weights)
    held = constant(weights)
    if "idx" in rows.columns:
        held = F.transform("idx", lambda i: F.get(constant(weights), i))
    return rows.withColumn("score", dot(F.col("x"), held))


def worker_gradients(rows: DataFrame, weights, algo: str) -> DataFrame:
    """(worker, key, g, batch): sums of minus the pull times x, divided by the worker's rows."""
    pull = LOSSES[algo][1]
    rows = scored(rows, weights).withColumn("pull", pull(F.col("score"), F.col("y")))
    if "idx" not in rows.columns:
        long = rows.select("worker", F.posexplode(F.transform("x", lambda v: -F.col("pull") * v)).alias("key", "v"))
        return long.groupBy("worker", "key").agg((F.sum("v") / F.count("*")).alias("g"), F.count("*").alias("batch"))
    # A key occurs in some rows only: rows are counted apart, by worker.
    size = rows.groupBy("worker").agg(F.count("*").alias("batch"))
    long = rows.select("worker", F.explode(F.arrays_zip("idx", F.transform("x", lambda v: -F.col("pull") * v).alias("v"))).alias("p")).select("worker", F.col("p.idx").alias("key"), F.col("p.v").alias("v"))
    sums = long.groupBy("worker", "key").agg(F.sum("v").alias("g"))
    return active(sums, len(weights)).join(F.broadcast(size), "worker").select("worker", "key", (F.col("g") / F.col("batch")).alias("g"), "batch")


def active(sums: DataFrame, dim: int) -> DataFrame:
    """Sums of each worker without negligible ones, if at most two thirds of the keys are left; else all keys, 0 where there is none."""
    kept = sums.groupBy("worker").agg(F.count_if(F.abs("g") > EPS).alias("nnz"))
    marked = sums.join(F.broadcast(kept), "worker")  # one row for each worker
    full = F.col("nnz") > dim * 2 // 3
    keys = sums.sparkSession.range(dim).select(F.col("id").cast(dict(sums.dtypes)["key"]).alias("key"))
    missing = keys.join(F.broadcast(kept.where(full).select("worker"))).join(sums.select("worker", "key"), ["worker", "key"], "left_anti").select("worker", "key", F.lit(0.0).alias("g"))
    return marked.where(full | (F.abs("g") > EPS)).select("worker", "key", "g").unionByName(missing)


#: Keys of a batch's sums that aren't the model's: rows, and their losses.
ROWS, LOSS = -1, -2


def batch_sums(rows: DataFrame, algo: str) -> DataFrame:
    """(worker, key, g) of scored rows in one pass: sums of minus the pull times x by key, and rows and losses under keys of their own."""
    loss, pull = (f(F.col("score"), F.col("y")) for f in LOSSES[algo])
    entry = lambda key, value: F.struct(key.cast("long").alias("key"), value.cast("double").alias("g"))
    if "idx" in rows.columns:
        own = F.zip_with("idx", "x", lambda k, v: entry(k, -F.col("pull_") * v))
    else:
        own = F.transform("x", lambda v, k: entry(k, -F.col("pull_") * v))
    more = F.array(entry(F.lit(ROWS), F.lit(1.0)), entry(F.lit(LOSS), F.col("loss_")))
    each = rows.withColumns({"pull_": pull, "loss_": loss}).select("worker", F.explode(F.concat(own, more)).alias("e"))
    return each.select("worker", "e.*").groupBy("worker", "key").agg(F.sum("g").alias("g"))


def gradients_of(sums: DataFrame, dim: int | None) -> DataFrame:
    """(worker, key, g) of ``batch_sums``: means over each worker's rows. With ``dim``, sparse gradients of so many keys."""
    rows = sums.where(F.col("key") == ROWS).select("worker", F.col("g").alias("rows"))  # one row for each worker
    own = sums.where("key >= 0")
    own = own if dim is None else active(own, dim)
    return own.join(F.broadcast(rows), "worker").select("worker", "key", (F.col("g") / F.col("rows")).alias("g"))


def with_l2(gradients: DataFrame, weights, l2: float) -> DataFrame:
    """The pull of the penalty, on every key of the gradient."""
    if l2 <= EPS:
        return gradients
    if len(weights) <= LITERALS:
        return gradients.withColumn("g", F.col("g") + l2_pull(F.get(constant(weights), F.col("key").cast("int")), l2))
    table = gradients.sparkSession.createDataFrame(pd.DataFrame({"key": np.arange(len(weights)), "w": np.asarray(weights, float)}))
    return gradients.join(table, "key").withColumn("g", F.col("g") + l2_pull(F.col("w"), l2)).select(*gradients.columns)


def coded(gradients: DataFrame, s: Settings, dim: int | None = None, stored: bool = False) -> DataFrame:
    """Each worker's gradient after coding and decoding; all workers' in the same jobs, however many there are.

    A gradient with all ``dim`` keys is dense; by default there are as many as the greatest key asks for. A dense one keeps
    its quantile bins under ``sketch``, a sparse one puts them into a grouped min-max sketch. ``stored``: gradients come from a
    table that is written, so they aren't written again.
    """
    g = gradients.select("worker", "key", F.col("g").cast("double").alias("g"))
    if s.codec == "none":
        return g
    if s.codec == "float":
        return g.withColumn("g", F.col("g").cast("float").cast("double"))
    g = g if stored else cut(g)  # read by the fit and by the coding
    if s.codec == "fixed_point":
        norm = g.groupBy("worker").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))
        code = codecs.fixed_code(F.col("g"), F.col("norm"), s.bits, codecs.rounding_bit(F.col("key")))
        return g.join(F.broadcast(norm), "worker").select("worker", "key", codecs.fixed_value(code, F.col("norm"), s.bits).alias("g"))
    kind = "quantile" if s.codec == "sketch" else s.codec
    fitted = quantize.fit_by(kind, g, "g", "worker", s.bins)
    splits, least, greatest = F.col("splits"), F.col("least"), F.col("greatest")
    decoded = lambda bin_: quantize.decoded_in(bin_, splits, least, greatest).alias("g")
    bin_ = quantize.bin_in(F.col("g"), splits, s.bins)
    if s.codec != "sketch":
        return g.join(fitted, "worker").select("worker", "key", bin_.alias("bin"), "splits", "least", "greatest").select("worker", "key", decoded(F.col("bin")))
    size = g.groupBy("worker").agg(F.count("*").alias("held"), F.max("key").alias("last"))
    dim = dim or size.agg(F.coalesce(F.max("last") + 1, F.lit(0))).first()[0]
    known = cut(fitted.join(size, "worker").withColumns({"zero": quantize.zero_in(splits, least, greatest), "bins": F.size(splits) + 1}).withColumn("edges", minmax.group_edges_in(F.col("zero"), F.col("bins"), s.groups)))  # a row for each worker
    binned = g.join(known, "worker").withColumn("bin", bin_)
    dense = F.col("held") == dim
    out = binned.where(dense).select("worker", "key", decoded(F.col("bin")))
    group = F.struct("worker", minmax.group_of(F.col("bin"), F.col("edges")).alias("group")).alias("group")
    pairs = cut(binned.where(~dense).select(group, "key", (F.col("bin") - F.col("zero")).alias("bin")))
    back = minmax.restore(pairs.select("group", "key"), *minmax.build(pairs, 0, s.rows, s.ratio), 0, s.rows).select("group.worker", "key", "bin")
    return out.unionByName(back.join(known, "worker").select("worker", "key", decoded(F.col("bin") + F.col("zero"))))


def summed(gradients: DataFrame, workers: int) -> DataFrame:
    return gradients.groupBy("key").agg((F.sum("g") / workers).alias("g"))


@dataclass
class State:
    """Weights and Adam's moments, with the powers of its decay rates."""

    w: np.ndarray
    m: np.ndarray = field(init=False)
    v: np.ndarray = field(init=False)
    b1: float = 0.9
    b2: float = 0.999

    def __post_init__(self):
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def sgd(self, keys: np.ndarray, g: np.ndarray, s: Settings, epoch: int) -> None:
        self.w[keys] -= sgd_rate(s.learn_rate, s.learn_decay, epoch) * g

    def adam(self, keys: np.ndarray, g: np.ndarray, s: Settings, advance: bool) -> None:
        """Only keys of the gradient move. Powers advance once an epoch, unless asked to do so at every step."""
        if advance:
            self.b1, self.b2 = self.b1 * 0.9, self.b2 * 0.999
        self.m[keys] = 0.9 * self.m[keys] + 0.1 * g
        self.v[keys] = 0.999 * self.v[keys] + 0.001 * g * g
        self.w[keys] -= s.learn_rate * np.sqrt(1 - self.b2) * self.m[keys] / ((1 - self.b1) * (np.sqrt(self.v[keys]) + 1e-8))


def truncated(w: np.ndarray, alpha: float) -> np.ndarray:
    """Weights pulled towards zero by alpha, stopping there."""
    return np.sign(w) * np.maximum(0.0, np.abs(w) - alpha)


def penalty(w: np.ndarray, s: Settings) -> float:
    """What the weights add to the loss."""
    return (s.reg_l1 * float(np.abs(w).sum()) if s.reg_l1 > EPS else 0.0) + (s.reg_l2 * float(np.sqrt((w**2).sum())) if s.reg_l2 > EPS else 0.0)


class ArrayModel:
    """A model that the driver holds."""

    def __init__(self, state: State, s: Settings):
        self.state, self.s, self.dim = state, s, len(state.w)

    def scored(self, rows: DataFrame) -> DataFrame:
        return scored(rows, self.state.w)

    def with_l2(self, gradients: DataFrame) -> DataFrame:
        return with_l2(gradients, self.state.w, self.s.reg_l2)

    def penalty(self) -> float:
        return penalty(self.state.w, self.s)

    def step(self, gradient: DataFrame, epoch: int, last: bool) -> None:
        g = gradient.orderBy("key").toPandas()  # as long as the model
        keys, values = g["key"].to_numpy(), g["g"].to_numpy(float)
        if self.s.optimizer == "sgd":
            self.state.sgd(keys, values, self.s, epoch + last)
        else:
            self.state.adam(keys, values, self.s, last or self.s.per_step_powers)
        if self.s.reg_l1 > EPS:
            self.state.w = truncated(self.state.w, self.s.reg_l1 * self.s.learn_rate)

    def save(self, spark: SparkSession, path: str) -> None:
        t = self.state
        spark.createDataFrame(pd.DataFrame({"key": np.arange(self.dim), "w": t.w, "m": t.m, "v": t.v})).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        t = spark.read.parquet(path).orderBy("key").toPandas()
        self.state.w, self.state.m, self.state.v = (t[k].to_numpy(float).copy() for k in ("w", "m", "v"))


METRICS = "epoch int, batch int, train_loss double, valid_loss double, accuracy double, auc double, b1 double, b2 double"


def epoch_losses(metrics: DataFrame) -> DataFrame:
    """(epoch, loss): the mean of the batches' losses, of rows (epoch, loss)."""
    return metrics.groupBy("epoch").agg(F.avg("loss").alias("loss"))


def kept_losses(spark: SparkSession, path: str) -> DataFrame:
    """The same of the metrics that a run keeps in ``path``."""
    return epoch_losses(spark.read.schema(METRICS).parquet(f"{path}/metrics").where("batch >= 0").select("epoch", F.col("train_loss").alias("loss")))


def train(model, held: Held, valid: DataFrame, s: Settings, scratch: Scratch, path: str | None = None) -> list[tuple]:
    """(epoch, train loss, valid loss, accuracy, AUC) of each epoch; the model steps. With ``path``, metrics and weights of
    every epoch are kept there, and a run goes on after the last epoch that is complete there."""
    spark, loss, history = held.spark, LOSSES[s.algo][0], []
    done = _resumed(spark, model, path, history)
    for epoch in range(done, s.epochs):
        losses = []
        for b in range(s.batches):
            rows = held.batch(epoch * s.batches + b, s.batch_ratio)
            sums = scratch.put(batch_sums(model.scored(rows), s.algo))
            head = sums.where("key < 0").groupBy("key").agg(F.sum("g").alias("g")).collect()
            total = {r["key"]: r["g"] for r in head}
            if not total:
                continue
            losses.append((epoch, b, total[LOSS] / total[ROWS] + model.penalty()))
            g = gradients_of(sums, model.dim if "idx" in rows.columns else None)
            model.step(summed(coded(model.with_l2(g), s, model.dim, stored=True), s.workers), epoch, b == s.batches - 1)
        checked = model.scored(valid)
        found = metrics.confusion(checked, loss(F.col("score"), F.col("y"))).first()
        auc = metrics.auc(checked).first()["auc"] if found["n"] else None
        history.append((epoch, float(np.mean([x[2] for x in losses])) if losses else None, found["loss"], found["accuracy"], auc))
        if path:
            model.save(spark, f"{path}/weights/{epoch}")
            rows = [(e, b, float(x), None, None, None, None, None) for e, b, x in losses] + [(epoch, -1, *history[-1][1:], model.state.b1, model.state.b2)]
            spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(f"{path}/metrics")
    return history


def _resumed(spark: SparkSession, model, path: str | None, history: list[tuple]) -> int:
    """The first epoch that is left, the model and the history up to it. Metrics are written last, so an epoch that has them is complete."""
    folder = path and spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metrics")
    if not folder or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0
    rows = spark.read.schema(METRICS).parquet(f"{path}/metrics").where("batch = -1").orderBy("epoch").collect()  # a row for each epoch
    if not rows:
        return 0
    history += [(r["epoch"], r["train_loss"], r["valid_loss"], r["accuracy"], r["auc"]) for r in rows]
    model.load(spark, f"{path}/weights/{rows[-1]['epoch']}")
    model.state.b1, model.state.b2 = rows[-1]["b1"], rows[-1]["b2"]
    return rows[-1]["epoch"] + 1


def fit(df: DataFrame, s: Settings, id: str = "id", dim: int | None = None, path: str | None = None) -> tuple[np.ndarray, list[tuple]]:
    """(weights, (epoch, train loss, valid loss, accuracy, AUC) of each epoch) for rows (id, y, x), or sparse ones (id, y, idx, x) of ``dim`` places."""
    learn, valid = split(df, id, s.valid_ratio)
    with Scratch(df.sparkSession) as scratch:
        held = Held.store(dealt(learn, id, s.workers), f"{scratch.folder}/rows", s.batch_ratio)
        first = held.rows().select(F.size("x").alias("d")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        model = ArrayModel(State(np.zeros(dim or first["d"])), s)
        history = train(model, held, valid, s, scratch, path)
        return model.state.w, history
