"""Queries over linear models: losses, gradients, optimizer steps, training and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses
from ..functions.hashes import hashed_sql
from ..functions.vectors import constant, dot
from ..operators import compressors, glm, metrics, params
from ..sources.shared import Scratch, cut
from .registry import merging_sql, query, table

DIM = 64
#: Fixed weights of the queries that need some.
WEIGHTS = [((k * 37) % 11 - 5) / 10.0 for k in range(DIM)]
L2 = 0.1

_W = "w AS (SELECT k AS key, ((k * 37) % 11 - 5) / 10.0::DOUBLE AS w FROM (SELECT unnest(range(0, 64)) AS k)), "
_X = "x AS (SELECT vec_id, vec_id % 4 AS worker, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS y, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS key FROM embeddings), "
_S = "s AS (SELECT vec_id, worker, y, sum(x * w) AS score FROM x JOIN w USING (key) GROUP BY 1, 2, 3) "
_SCORES = "WITH " + _W + _X + _S
_Z = "(score * y)"
LOSS_SQL = {
    "logistic": f"CASE WHEN {_Z} > 18 THEN exp(-{_Z}) WHEN {_Z} < -18 THEN -{_Z} ELSE ln(exp(-{_Z}) + 1) END",
    "hinge": f"greatest(0.0::DOUBLE, 1 - {_Z})",
    "square": "0.5::DOUBLE * (score - y) * (score - y)",
}
PULL_SQL = {
    "logistic": f"CASE WHEN {_Z} > 18 THEN y * exp(-{_Z}) WHEN {_Z} < -18 THEN y ELSE y / (exp({_Z}) + 1) END",
    "hinge": f"CASE WHEN {_Z} <= 1 THEN y ELSE 0.0::DOUBLE END",
    "square": "y - score",
}


def _rows(spark, d):
    y = F.when(F.col("label") == 0, 1.0).otherwise(-1.0)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(4)).alias("worker"), y.alias("y"), F.col("embedding").cast("array<double>").alias("x"))


def _scored(spark, d):
    return glm.scored(_rows(spark, d), WEIGHTS)


@query("linear_score", _SCORES + "SELECT vec_id AS id, round(score, 8) AS score FROM s")
def linear_score(spark, d):
    return _scored(spark, d).select("id", F.round("score", 8).alias("score"))


def _loss_query(name, algo):
    @query(f"loss_{name}", _SCORES + f"SELECT vec_id AS id, round({LOSS_SQL[algo]}, 8) AS loss FROM s")
    def run(spark, d):
        return _scored(spark, d).select("id", F.round(losses.LOSSES[algo][0](F.col("score"), F.col("y")), 8).alias("loss"))

    return run


for _name, _algo in (("log", "logistic"), ("hinge", "hinge"), ("square", "square")):
    _loss_query(_name, _algo)


@query("loss_grad_all", _SCORES + f"SELECT vec_id AS id, round({PULL_SQL['logistic']}, 8) AS logistic, round({PULL_SQL['hinge']}, 8) AS hinge, round({PULL_SQL['square']}, 8) AS square FROM s")
def loss_grad_all(spark, d):
    return _scored(spark, d).select("id", *(F.round(pull(F.col("score"), F.col("y")), 8).alias(k) for k, (_, pull) in losses.LOSSES.items()))


@query("loss_tails", "WITH e AS (SELECT event_id, (value - 50) / 2 AS score, 1.0::DOUBLE AS y FROM events) SELECT event_id, round(" + LOSS_SQL["logistic"] + ", 8) AS loss, round(" + PULL_SQL["logistic"] + ", 8) AS pull FROM e")
def loss_tails(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("value") - 50) / 2).alias("score"), F.lit(1.0).alias("y"))
    return e.select("event_id", F.round(losses.log_loss(F.col("score"), F.col("y")), 8).alias("loss"), F.round(losses.log_pull(F.col("score"), F.col("y")), 8).alias("pull"))


# ---------------------------------------------------------------- penalties, on a weight vector made of data

_AVG = "WITH g AS (SELECT l_linenumber AS key, avg(l_discount) - 0.05::DOUBLE AS w FROM lineitem GROUP BY 1) "


def _averages(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("key")).agg((F.avg("l_discount") - 0.05).alias("w"))


@query("reg_value", _AVG + "SELECT round(0.1::DOUBLE * sum(abs(w)), 9) AS l1, round(0.1::DOUBLE * sqrt(sum(w * w)), 9) AS l2 FROM g")
def reg_value(spark, d):
    w = F.col("w")
    return _averages(spark, d).agg(F.round(losses.l1_value(w, 0.1), 9).alias("l1"), F.round(losses.l2_value(w, 0.1), 9).alias("l2"))


@query("l1_truncate", _AVG + "SELECT key, round(sign(w) * greatest(0.0::DOUBLE, abs(w) - 0.0002::DOUBLE), 9) + 0.0 AS w FROM g")
def l1_truncate(spark, d):
    return _averages(spark, d).select("key", (F.round(losses.truncated(F.col("w"), 0.0002), 9) + 0.0).alias("w"))


# ---------------------------------------------------------------- gradients

def _grad_sql(algo: str, l2: bool = True, per_worker: bool = False) -> str:
    by, group = ("worker, key", "worker, key") if per_worker else ("key", "key")
    term = f" + {L2} * max(w)" if l2 else ""
    return _SCORES[:-1] + f", p AS (SELECT vec_id, {PULL_SQL[algo]} AS pull FROM s), g AS (SELECT {by.replace('worker', 'x.worker')}, sum(-pull * x) / count(*){term} AS g FROM x JOIN p ON p.vec_id = x.vec_id JOIN w USING (key) GROUP BY {group.replace('worker', 'x.worker')}) "


def _one(rows):
    return rows.withColumn("worker", F.lit(0))


def _gradient_query(name, algo):
    @query(f"{name}_gradient_step", _grad_sql(algo) + "SELECT key, round(g, 9) AS g FROM g")
    def run(spark, d):
        g = glm.with_l2(glm.worker_gradients(_one(_rows(spark, d)), WEIGHTS, algo), WEIGHTS, L2)
        return g.select(F.col("key").cast("long").alias("key"), F.round("g", 9).alias("g"))

    return run


for _name, _algo in (("lr", "logistic"), ("svm", "hinge"), ("linreg", "square")):
    _gradient_query(_name, _algo)


@query("l2_grad_term", "WITH " + _W[:-2] + " SELECT key, round(0.1::DOUBLE * w * n, 9) AS term FROM w, (SELECT count(*) AS n FROM embeddings)")
def l2_grad_term(spark, d):
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    return n.select("n", F.posexplode(constant(WEIGHTS)).alias("key", "w")).select(F.col("key").cast("long").alias("key"), F.round(losses.l2_pull(F.col("w"), 0.1) * F.col("n"), 9).alias("term"))


@query("worker_gradient_sum", _grad_sql("logistic", True, True) + "SELECT key, round(sum(g) / 4, 9) AS g FROM g GROUP BY key")
def worker_gradient_sum(spark, d):
    g = glm.with_l2(glm.worker_gradients(_rows(spark, d), WEIGHTS, "logistic"), WEIGHTS, L2)
    return glm.summed(g, 4).select(F.col("key").cast("long").alias("key"), F.round("g", 9).alias("g"))


@query("batch_loss", _SCORES + "SELECT round(sum(" + LOSS_SQL["logistic"] + ") / count(*) + 0.1::DOUBLE * (SELECT sqrt(sum(w * w)) FROM w), 9) AS loss FROM s")
def batch_loss(spark, d):
    penalty = L2 * sum(w * w for w in WEIGHTS) ** 0.5
    return _scored(spark, d).agg(F.round(F.sum(losses.log_loss(F.col("score"), F.col("y"))) / F.count("*") + penalty, 9).alias("loss"))


def _coded_sql(codec: str, bins: int = 32) -> str | None:
    """Each worker's gradient after coding, summed; a worker's gradient has all 64 keys here."""
    split = {"quantile": f"SELECT DISTINCT worker, g AS v FROM (SELECT worker, g, row_number() OVER (PARTITION BY worker ORDER BY g) - 1 AS r, count(*) OVER (PARTITION BY worker) AS n FROM g) o JOIN (SELECT unnest(range(1, {bins})) AS i) e ON o.r = (o.n * e.i) // {bins}",
             "uniform": f"SELECT DISTINCT worker, lo + (hi - lo) / {bins} * i AS v FROM lim, (SELECT unnest(range(1, {bins})) AS i)"}
    split["sketch"] = split["quantile"]  # a gradient with all keys is dense, and keeps its quantile bins
    split["least_squares"] = "SELECT DISTINCT worker, low AS v FROM p8 WHERE i > 0"
    merge = ", p0 AS (SELECT worker, row_number() OVER (PARTITION BY worker ORDER BY g) - 1 AS i, 1 AS n, g AS s, g * g AS q, g AS low FROM g)" + merging_sql(bins, 8) if codec == "least_squares" else ""
    end = "SELECT key, round(sum(d) / 4, 9) AS g FROM coded GROUP BY key"
    if codec == "float":
        return _grad_sql("logistic", False, True) + ", coded AS (SELECT key, g::FLOAT::DOUBLE AS d FROM g) " + end
    if codec == "fixed_point":
        size = "least(127, floor(abs(g) / norm * 127) + (floor(key::BIGINT * 2654435761 / 65536)::BIGINT % 2))"
        return _grad_sql("logistic", False, True) + f", norms AS (SELECT worker, sqrt(sum(g * g)) AS norm FROM g GROUP BY worker), coded AS (SELECT key, sign(g) * {size} / 127 * norm AS d FROM g JOIN norms USING (worker)) " + end
    if codec in split:
        return (
            _grad_sql("logistic", False, True) + merge + f", lim AS (SELECT worker, min(g) AS lo, max(g) AS hi FROM g GROUP BY worker), sp AS ({split[codec]}), "
            "mid AS (SELECT worker, row_number() OVER w - 1 AS bin, 0.5::DOUBLE * (coalesce(lag(b) OVER w, lo) + b) AS d FROM (SELECT worker, v AS b, 0 AS k FROM sp UNION ALL SELECT worker, hi, 1 FROM lim) JOIN lim USING (worker) WINDOW w AS (PARTITION BY worker ORDER BY k, b)), "
            "coded AS (SELECT b.key, mid.d FROM (SELECT g.worker, g.key, (SELECT count(*) FROM sp WHERE sp.worker = g.worker AND sp.v <= g.g) AS bin FROM g) b JOIN mid ON mid.worker = b.worker AND mid.bin = b.bin) " + end
        )
    return None


def _codec_query(codec):
    @query(f"worker_gradient_{codec}", _coded_sql(codec))
    def run(spark, d):
        s = glm.Settings(codec=codec, bins=32)
        g = glm.coded(glm.worker_gradients(_rows(spark, d), WEIGHTS, "logistic"), s)
        return glm.summed(g, 4).select(F.col("key").cast("long").alias("key"), F.round("g", 9).alias("g"))

    return run


for _codec in ("float", "fixed_point", "quantile", "uniform", "least_squares", "sketch"):
    _codec_query(_codec)


_SPARSE = (
    "WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0 END AS y, o_custkey % 20 AS k1, 40 + o_orderkey % 5 AS k2, o_totalprice / 1e6 AS v2 FROM orders), "
    + _W + "x AS (SELECT id, y, k1 AS key, 1.0::DOUBLE AS x FROM r UNION ALL SELECT id, y, k2, v2 FROM r), s AS (SELECT id, y, sum(x * w) AS score FROM x JOIN w USING (key) GROUP BY 1, 2), "
    f"p AS (SELECT id, {PULL_SQL['logistic']} AS pull FROM s), g AS (SELECT key, sum(-pull * x) AS g FROM x JOIN p USING (id) GROUP BY key) "
)


def _sparse_step(orders, place):
    idx = F.array(place.cast("int"), (40 + F.col("o_orderkey") % 5).cast("int"))
    rows = orders.select(F.lit(0).alias("worker"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0).alias("y"), idx.alias("idx"), F.array(F.lit(1.0), F.col("o_totalprice") / 1e6).alias("x"))
    g = glm.with_l2(glm.worker_gradients(rows, WEIGHTS, "logistic"), WEIGHTS, L2)
    return g.select(F.col("key").cast("long").alias("key"), F.round("g", 9).alias("g"))


@query("sparse_gradient_step_whole", _SPARSE + "SELECT key, round(g / (SELECT count(*) FROM r) + 0.1::DOUBLE * w, 9) AS g FROM g JOIN w USING (key) WHERE abs(g) > 1e-8")
def sparse_gradient_step_whole(spark, d):
    """Keys are absent by their mapping."""
    return _sparse_step(table(spark, d, "orders"), F.col("o_custkey") % 20)


# ---------------------------------------------------------------- optimizer steps

@query("sgd_step", _grad_sql("logistic") + "SELECT key, round(w - 0.1::DOUBLE / sqrt(1 + 0.9::DOUBLE * 2) * g, 9) AS w FROM g JOIN w USING (key)")
def sgd_step(spark, d):
    g = glm.with_l2(glm.worker_gradients(_one(_rows(spark, d)), WEIGHTS, "logistic"), WEIGHTS, L2)
    w = F.element_at(constant(WEIGHTS), F.col("key") + 1)
    return g.select(F.col("key").cast("long").alias("key"), F.round(losses.sgd_step(w, F.col("g"), 0.1, 0.9, 2), 9).alias("w"))


def _adam_sql(steps: int) -> str:
    """Steps from zero weights on all rows; powers of the decay rates stay at the first."""
    sql = "WITH " + _X + "w0 AS (SELECT k AS key, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT unnest(range(0, 64)) AS k)) "
    for i in range(steps):
        sql += f", s{i} AS (SELECT vec_id, y, sum(x * w) AS score FROM x JOIN w{i} USING (key) GROUP BY 1, 2), p{i} AS (SELECT vec_id, {PULL_SQL['logistic']} AS pull FROM s{i}), g{i} AS (SELECT key, sum(-pull * x) / count(*) AS g FROM x JOIN p{i} USING (vec_id) GROUP BY key), "
        sql += f"m{i} AS (SELECT key, w, 0.9::DOUBLE * m + 0.1::DOUBLE * (g + 0.1::DOUBLE * w) AS m, 0.999::DOUBLE * v + 0.001::DOUBLE * (g + 0.1::DOUBLE * w) * (g + 0.1::DOUBLE * w) AS v FROM g{i} JOIN w{i} USING (key)), "
        sql += f"w{i + 1} AS (SELECT key, w - 0.1::DOUBLE * sqrt(1 - 0.999::DOUBLE) * m / ((1 - 0.9::DOUBLE) * (sqrt(v) + 1e-8::DOUBLE)) AS w, m, v FROM m{i}) "
    return sql + f"SELECT key, round(w, 7) AS w FROM w{steps}"


def _adam(steps):
    def run(spark, d):
        import numpy as np

        rows, s, state = _one(_rows(spark, d)).persist(), glm.Settings(), glm.State(np.zeros(DIM))
        for _ in range(steps):
            g = glm.with_l2(glm.worker_gradients(rows, state.w, "logistic"), state.w, L2).orderBy("key").toPandas()
            state.adam(g["key"].to_numpy(), g["g"].to_numpy(float), s, False)
        rows.unpersist()
        return spark.createDataFrame([(k, float(w)) for k, w in enumerate(state.w)], "key long, w double").select("key", F.round("w", 7).alias("w"))

    return run


query("adam_step", _adam_sql(1))(_adam(1))
query("adam_3_steps", _adam_sql(3))(_adam(3))


@query("adam_sparse_step_whole", "WITH g AS (SELECT 2 * l_linenumber AS key, avg(l_discount) - 0.05::DOUBLE AS g FROM lineitem GROUP BY 1) SELECT k AS key, round(CASE WHEN g IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - 0.1::DOUBLE * sqrt(1 - 0.999::DOUBLE) * (0.1::DOUBLE * g) / ((1 - 0.9::DOUBLE) * (sqrt(0.001::DOUBLE * g * g) + 1e-8::DOUBLE)) END, 6) AS w FROM (SELECT unnest(range(0, 16)) AS k) LEFT JOIN g ON g.key = k")
def adam_sparse_step_whole(spark, d):
    """Odd keys are absent."""
    return _adam_from_ones(spark, table(spark, d, "lineitem"), 2 * F.col("l_linenumber"), 16)


def _adam_from_ones(spark, items, key, dim):
    import numpy as np

    g = items.groupBy(key.alias("key")).agg((F.avg("l_discount") - 0.05).alias("g")).toPandas()
    state = glm.State(np.ones(dim))
    state.adam(g["key"].to_numpy(), g["g"].to_numpy(float), glm.Settings(), False)
    return spark.createDataFrame([(k, float(w)) for k, w in enumerate(state.w)], "key long, w double").select("key", F.round("w", 6).alias("w"))


# ---------------------------------------------------------------- validation and training

@query("confusion_metrics", _SCORES + "SELECT round(avg(" + LOSS_SQL["logistic"] + "), 8) AS loss, count(*) AS n, count(*) FILTER (score * y > 0 AND y > 0) AS tp, count(*) FILTER (score * y > 0 AND y < 0) AS tn, count(*) FILTER (score * y < 0 AND y < 0) AS fp, count(*) FILTER (score * y < 0 AND y > 0) AS fn, round(count(*) FILTER (score * y > 0) / count(*), 8) AS accuracy, round(count(*) FILTER (score * y > 0 AND y > 0) / count(*) FILTER (score * y <> 0 AND y > 0), 8) AS true_recall, round(count(*) FILTER (score * y > 0 AND y < 0) / count(*) FILTER (score * y <> 0 AND y < 0), 8) AS false_recall FROM s")
def confusion_metrics(spark, d):
    c = metrics.confusion(_scored(spark, d), losses.log_loss(F.col("score"), F.col("y")))
    return c.select(*(F.round(k, 8).alias(k) if k in ("loss", "accuracy", "true_recall", "false_recall") else k for k in c.columns))


@query("auc_rank", "WITH e AS (SELECT value AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS y FROM events), r AS (SELECT y, avg(k) OVER (PARTITION BY score) AS k FROM (SELECT score, y, row_number() OVER (ORDER BY score) AS k FROM e)) SELECT round((sum(k) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2) / (count(*) FILTER (y > 0) * count(*) FILTER (y < 0)), 8) AS auc FROM r")
def auc_rank(spark, d):
    e = table(spark, d, "events").select(F.col("value").alias("score"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("y"))
    return metrics.auc(e).select(F.round("auc", 8).alias("auc"))


def _codec_step(codec: str, bins: int, i: int) -> str:
    """CTE c<i>(key, d) of g<i>(worker, key, g)."""
    if codec == "none":
        return f"c{i} AS (SELECT key, g AS d FROM g{i})"
    if codec == "fixed_point":
        size = "least(127, floor(abs(g) / norm * 127) + (floor(key::BIGINT * 2654435761 / 65536)::BIGINT % 2))"
        return f"c{i} AS (SELECT key, sign(g) * {size} / 127 * norm AS d FROM g{i} JOIN (SELECT worker, sqrt(sum(g * g)) AS norm FROM g{i} GROUP BY worker) USING (worker))"
    return (
        f"sp{i} AS MATERIALIZED (SELECT DISTINCT worker, g AS v FROM (SELECT worker, g, row_number() OVER (PARTITION BY worker ORDER BY g) - 1 AS r, count(*) OVER (PARTITION BY worker) AS n FROM g{i}) o JOIN (SELECT unnest(range(1, {bins})) AS i) e ON o.r = (o.n * e.i) // {bins}), "
        f"lim{i} AS MATERIALIZED (SELECT worker, min(g) AS lo, max(g) AS hi FROM g{i} GROUP BY worker), "
        f"mid{i} AS MATERIALIZED (SELECT worker, row_number() OVER w - 1 AS bin, 0.5::DOUBLE * (coalesce(lag(b) OVER w, lo) + b) AS d FROM (SELECT worker, v AS b, 0 AS k FROM sp{i} UNION ALL SELECT worker, hi, 1 FROM lim{i}) JOIN lim{i} USING (worker) WINDOW w AS (PARTITION BY worker ORDER BY k, b)), "
        f"c{i} AS (SELECT b.key, m.d FROM (SELECT g.worker, g.key, (SELECT count(*) FROM sp{i} sp WHERE sp.worker = g.worker AND sp.v <= g.g) AS bin FROM g{i} g) b JOIN mid{i} m ON m.worker = b.worker AND m.bin = b.bin)"
    )


def _training_sql(s: glm.Settings) -> str:
    """All steps of a run over the embeddings, unrolled."""
    parts = [
        f"e AS MATERIALIZED (SELECT vec_id AS id, vec_id % {s.workers} AS worker, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS y, embedding, (vec_id * 7919) % 1000 < {int(s.valid_ratio * 1000)} AS valid FROM embeddings)",
        "t AS MATERIALIZED (SELECT id, worker, y, row_number() OVER (PARTITION BY worker ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY worker) AS size FROM e WHERE NOT valid)",
        "x AS MATERIALIZED (SELECT id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS key FROM e)",
        "w0 AS MATERIALIZED (SELECT k AS key, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT unnest(range(0, 64)) AS k))",
    ]
    b1, b2, ends = 0.9, 0.999, []
    for i in range(s.epochs * s.batches):
        epoch, b = divmod(i, s.batches)
        last = b == s.batches - 1
        if last:
            b1, b2 = b1 * 0.9, b2 * 0.999
        parts += [
            f"s{i} AS MATERIALIZED (SELECT id, worker, y, sum(x * w) AS score FROM (SELECT * FROM t WHERE ((pos - {i} * floor(size * {s.batch_ratio}::DOUBLE)::BIGINT) % size + size) % size < floor(size * {s.batch_ratio}::DOUBLE)) JOIN x USING (id) JOIN w{i} USING (key) GROUP BY 1, 2, 3)",
            f"l{i} AS (SELECT avg({LOSS_SQL[s.algo]}) + {s.reg_l2}::DOUBLE * (SELECT sqrt(sum(w * w)) FROM w{i}) AS l FROM s{i})",
            f"g{i} AS MATERIALIZED (SELECT worker, key, sum(-pull * x) / count(*) + {s.reg_l2}::DOUBLE * max(w) AS g FROM x JOIN (SELECT id, worker, {PULL_SQL[s.algo]} AS pull FROM s{i}) USING (id) JOIN w{i} USING (key) GROUP BY worker, key)",
            _codec_step(s.codec, s.bins, i),
            f"a{i} AS MATERIALIZED (SELECT key, sum(d) / {s.workers} AS g FROM c{i} GROUP BY key)",
        ]
        if s.optimizer == "sgd":
            parts.append(f"w{i + 1} AS MATERIALIZED (SELECT key, w - {losses.sgd_rate(s.learn_rate, s.learn_decay, epoch + last)!r}::DOUBLE * g AS w, m, v FROM w{i} JOIN a{i} USING (key))")
        else:
            parts.append(f"u{i} AS (SELECT key, w, 0.9::DOUBLE * m + 0.1::DOUBLE * g AS m, 0.999::DOUBLE * v + 0.001::DOUBLE * g * g AS v FROM w{i} JOIN a{i} USING (key))")
            parts.append(f"w{i + 1} AS MATERIALIZED (SELECT key, w - {s.learn_rate * (1 - b2) ** 0.5!r}::DOUBLE * m / ({1 - b1!r}::DOUBLE * (sqrt(v) + 1e-8::DOUBLE)) AS w, m, v FROM u{i})")
        if last:
            parts.append(f"v{epoch} AS MATERIALIZED (SELECT y, sum(x * w) AS score FROM e JOIN x USING (id) JOIN w{i + 1} USING (key) WHERE valid GROUP BY id, y)")
            parts.append(f"k{epoch} AS (SELECT y, avg(k) OVER (PARTITION BY score) AS k FROM (SELECT y, score, row_number() OVER (ORDER BY score) AS k FROM v{epoch}))")
            auc = f"(SELECT (sum(k) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2) / (count(*) FILTER (y > 0) * count(*) FILTER (y < 0)) FROM k{epoch})"
            train = " + ".join(f"(SELECT l FROM l{j})" for j in range(epoch * s.batches, i + 1))
            ends.append(f"SELECT {epoch} AS epoch, round(({train}) / {s.batches}, 7) AS train_loss, round(avg({LOSS_SQL[s.algo]}), 7) AS valid_loss, round(count(*) FILTER (score * y > 0) / count(*), 7) AS accuracy, round({auc}, 7) AS auc FROM v{epoch}")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(ends)


def _fit_query(name, s):
    @query(name, _training_sql(s))
    def run(spark, d):
        _, history = glm.fit(_rows(spark, d).drop("worker"), s)
        found = spark.createDataFrame(history, "epoch int, train_loss double, valid_loss double, accuracy double, auc double")
        return found.select("epoch", *(F.round(c, 7).alias(c) for c in found.columns[1:]))

    return run


_fit_query("glm_fit_logistic", glm.Settings(epochs=2, batch_ratio=0.25))
_fit_query("glm_fit_svm_quantile", glm.Settings(algo="hinge", codec="quantile", bins=32, epochs=1, batch_ratio=0.25))
_fit_query("glm_fit_linreg_sgd", glm.Settings(algo="square", codec="fixed_point", optimizer="sgd", epochs=1, batch_ratio=0.25))


@query("epoch_loss", "SELECT l_linenumber % 3 AS epoch, round(avg(l_discount), 9) AS loss FROM lineitem GROUP BY 1")
def epoch_loss(spark, d):
    batches = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("epoch"), F.col("l_discount").alias("loss"))
    return glm.epoch_losses(batches).select("epoch", F.round("loss", 9).alias("loss"))


@query("epoch_loss_kept", f"SELECT epoch, train_loss AS loss FROM ({_training_sql(glm.Settings(epochs=2, batch_ratio=0.25))})")
def epoch_loss_kept(spark, d):
    """Of a run that stops after an epoch and goes on from the metrics and weights that it has kept."""
    with Scratch(spark) as scratch:
        for epochs in (1, 2):
            glm.fit(_rows(spark, d).drop("worker"), glm.Settings(epochs=epochs, batch_ratio=0.25), path=f"{scratch.folder}/run")
        found = glm.kept_losses(spark, f"{scratch.folder}/run").select("epoch", F.round("loss", 7).alias("loss")).collect()  # a row for each epoch
    return spark.createDataFrame(found, "epoch int, loss double")


# ---------------------------------------------------------------- gradients that most keys lack

_THIN = "g AS MATERIALIZED (SELECT l_linenumber % 4 AS worker, 3 * l_partkey AS key, sum(l_quantity)::DOUBLE - 75 AS g FROM lineitem GROUP BY 1, 2), "


def _thin(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 4).cast("int").alias("worker"), (3 * F.col("l_partkey")).alias("key")).agg((F.sum("l_quantity").cast("double") - 75).alias("g"))


def _sketch_by_worker_sql(bins: int = 64, groups: int = 8, ratio: float = 0.3, source: str = _THIN, end: str = "SELECT back.worker, back.key, round(d, 6) AS g FROM back JOIN mid ON mid.worker = back.worker AND mid.bin = back.bin") -> str:
    hashed = [f"SELECT kd.worker, kd.g, kd.key, kd.bin, {i} AS row, ((h.hash % s.cols) + s.cols) % s.cols AS cell FROM keyed kd JOIN sizes s ON s.worker = kd.worker AND s.g = kd.g JOIN ({hashed_sql(n, 'keys', 'key', 1 << 40).replace('AS hash', 'AS unused, x AS hash')}) h ON h.key = kd.key" for i, n in enumerate(("bj", "mix64"))]
    return (
        "WITH " + source + f"sp AS MATERIALIZED (SELECT DISTINCT worker, g AS v FROM (SELECT worker, g, row_number() OVER (PARTITION BY worker ORDER BY g) - 1 AS r, count(*) OVER (PARTITION BY worker) AS n FROM g) o JOIN (SELECT unnest(range(1, {bins})) AS i) e ON o.r = (o.n * e.i) // {bins}), "
        "lim AS MATERIALIZED (SELECT worker, min(g) AS lo, max(g) AS hi FROM g GROUP BY worker), "
        "mid AS MATERIALIZED (SELECT worker, row_number() OVER w - 1 AS bin, 0.5::DOUBLE * (coalesce(lag(b) OVER w, lo) + b) AS d FROM (SELECT worker, v AS b, 0 AS k FROM sp UNION ALL SELECT worker, hi, 1 FROM lim) JOIN lim USING (worker) WINDOW w AS (PARTITION BY worker ORDER BY k, b)), "
        "z AS MATERIALIZED (SELECT worker, CASE WHEN any_value(lo) > 0 THEN 0 WHEN any_value(hi) < 0 THEN count(*) ELSE count(*) FILTER (v < 0) END AS zero, count(*) + 1 AS bins FROM sp JOIN lim USING (worker) GROUP BY worker), "
        f"f AS MATERIALIZED (SELECT worker, zero, bins, bins // {groups} AS span, CASE WHEN zero < bins // {groups} THEN zero WHEN zero % (bins // {groups}) < (bins // {groups}) // 2 THEN bins // {groups} + zero % (bins // {groups}) ELSE zero % (bins // {groups}) END AS first FROM z), "
        "kb AS MATERIALIZED (SELECT worker, key, (SELECT count(*) FROM sp WHERE sp.worker = g.worker AND sp.v <= g.g) AS bin FROM g), "
        f"keyed AS MATERIALIZED (SELECT kb.worker, key, bin, (SELECT count(*) FROM (SELECT unnest(range(0, {groups - 1})) AS i) e WHERE f.first + e.i * f.span <= kb.bin) AS g FROM kb JOIN f ON f.worker = kb.worker), "
        f"sizes AS MATERIALIZED (SELECT worker, g, ceil(count(*) * {ratio}::DOUBLE)::BIGINT AS cols FROM keyed GROUP BY 1, 2), keys AS MATERIALIZED (SELECT DISTINCT key FROM g), h AS MATERIALIZED ({' UNION ALL '.join(hashed)}), "
        "cells AS MATERIALIZED (SELECT worker, g, row, cell, bin FROM (SELECT h.*, row_number() OVER (PARTITION BY h.worker, g, row, cell ORDER BY abs(bin - zero), key) AS o FROM h JOIN z ON z.worker = h.worker) WHERE o = 1), "
        "back AS MATERIALIZED (SELECT worker, key, bin FROM (SELECT h.worker, h.key, c.bin, row_number() OVER (PARTITION BY h.worker, h.key ORDER BY abs(c.bin - zero) DESC, h.row) AS o FROM h JOIN cells c ON c.worker = h.worker AND c.g = h.g AND c.row = h.row AND c.cell = h.cell JOIN z ON z.worker = h.worker) WHERE o = 1) " + end
    )


@query("sparse_gradient_sketch", _sketch_by_worker_sql())
def sparse_gradient_sketch(spark, d):
    """Each worker's gradient through a grouped min-max sketch of its own."""
    g = glm.coded(_thin(spark, d), glm.Settings(codec="sketch", bins=64))
    return g.select("worker", "key", F.round("g", 6).alias("g"))


# ---------------------------------------------------------------- many coded vectors

#: A vector for each supplier.
_MANY = "g AS MATERIALIZED (SELECT l_suppkey AS worker, 3 * l_partkey AS key, sum(l_quantity)::DOUBLE - 20 AS g FROM lineitem GROUP BY 1, 2), "


def _many(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("vec"), (3 * F.col("l_partkey")).alias("key")).agg((F.sum("l_quantity").cast("double") - 20).alias("value"))


@query("many_sparse_vectors", _sketch_by_worker_sql(16, source=_MANY, end="SELECT back.worker AS vec, back.key, round(d * (1 - 2 * (back.worker % 2)), 6) AS value FROM back JOIN mid ON mid.worker = back.worker AND mid.bin = back.bin"))
def many_sparse_vectors(spark, d):
    """All suppliers' vectors in the same tables, those of odd numbers scaled by -1."""
    coded = compressors.compress_sparse_many(_many(spark, d), bins=16).times(1.0 - 2 * (F.col("vec") % 2))
    return coded.decompress().select("vec", "key", F.round("value", 6).alias("value"))


@query("many_dense_vectors_sum", _sketch_by_worker_sql(16, source=_MANY, end="SELECT key, round(sum(d), 4) AS value FROM kb JOIN mid ON mid.worker = kb.worker AND mid.bin = kb.bin GROUP BY key"))
def many_dense_vectors_sum(spark, d):
    """The sum of all suppliers' coded vectors, stored and opened again."""
    with Scratch(spark) as scratch:
        compressors.compress_dense_many(_many(spark, d), bins=16).save(f"{scratch.folder}/vectors")
        found = compressors.DenseVectors.open(spark, f"{scratch.folder}/vectors", 16).summed()
        return cut(found.select("key", F.round("value", 4).alias("value")))  # the tables go


@query("gradient_sum_with_idle_worker", _grad_sql("logistic", False, True) + "SELECT key, round(sum(g) / 5, 9) AS g FROM g GROUP BY key")
def gradient_sum_with_idle_worker(spark, d):
    """A worker without rows has no gradient, which counts as zero in the mean over five workers."""
    g = glm.worker_gradients(_rows(spark, d), WEIGHTS, "logistic")
    idle = glm.worker_gradients(_rows(spark, d).where("false").withColumn("worker", F.lit(4)), WEIGHTS, "logistic")
    return glm.summed(g.unionByName(idle), 5).select(F.col("key").cast("long").alias("key"), F.round("g", 9).alias("g"))


# ---------------------------------------------------------------- parameters as a table

_TABLE_STEP = (
    "WITH r AS MATERIALIZED (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0 END AS y, o_custkey AS k1, o_totalprice / 1e6 AS v2 FROM orders), x AS MATERIALIZED (SELECT id, y, k1 AS key, 1.0::DOUBLE AS x FROM r UNION ALL SELECT id, y, 0, v2 FROM r), "
    "p0 AS MATERIALIZED (SELECT key, 0.001::DOUBLE * (key % 7) AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT DISTINCT key FROM x WHERE key % 2 = 0)), "
    "s AS MATERIALIZED (SELECT id, y, sum(x * coalesce(w, 0)) AS score FROM x LEFT JOIN p0 USING (key) GROUP BY 1, 2), "
    f"g AS MATERIALIZED (SELECT key, sum(-pull * x) / (SELECT count(*) FROM r) + 0.1::DOUBLE * coalesce(any_value(w), 0) AS g FROM x JOIN (SELECT id, {PULL_SQL['logistic']} AS pull FROM s) USING (id) LEFT JOIN p0 USING (key) GROUP BY key HAVING abs(sum(-pull * x)) > 1e-8) "
    "SELECT key, round(coalesce(w, 0) - 0.1::DOUBLE * sqrt(1 - 0.999::DOUBLE) * (0.1::DOUBLE * g) / ((1 - 0.9::DOUBLE) * (sqrt(0.001::DOUBLE * g * g) + 1e-8::DOUBLE)), 7) AS w FROM g LEFT JOIN p0 USING (key)"
)


@query("parameter_table_step", _TABLE_STEP)
def parameter_table_step(spark, d):
    """A step of a model whose weights are rows: features joined by key, a key that every row has, and half of the weights absent."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(0).alias("worker"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0).alias("y"),
        F.array(F.col("o_custkey"), F.lit(0).cast("long")).alias("idx"), F.array(F.lit(1.0), F.col("o_totalprice") / 1e6).alias("x"),
    )
    model = params.TableModel(spark, glm.Settings(workers=1), 1 << 40, None, params.hot_keys(rows))
    keys = rows.select(F.explode("idx").alias("key")).distinct().where("key % 2 = 0")
    model.table = keys.select("key", (0.001 * (F.col("key") % 7)).alias("w"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    g = model.with_l2(glm.gradients_of(glm.batch_sums(model.scored(rows), "logistic"), model.dim))
    stepped = params.adam(model.table, glm.summed(g, 1), 0.1, model.state)
    return stepped.join(g.select("key"), "key", "left_semi").select("key", F.round("w", 7).alias("w"))


def _dots(spark, d):
    return _rows(spark, d).select("id", dot(F.col("x"), F.col("x")).alias("norm2"))


@query("dense_dot", "SELECT vec_id AS id, round(sum(x * x), 7) AS norm2 FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def dense_dot(spark, d):
    return _dots(spark, d).select("id", F.round("norm2", 7).alias("norm2"))
