"""Quantizers of many vectors in the same jobs, stored batches, kept runs, parameter tables, places of a shuffle."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.functions import vectors
from quantaloom.operators import codecs, compressors, glm, order, params, quantize, ranks
from quantaloom.sources.shared import Scratch


def plain_least_squares(xs, bins):
    """Interval by interval, as a list."""
    parts = [(xs.count(v), xs.count(v) * v, xs.count(v) * v * v, v) for v in sorted(set(xs))] if len(xs) < 5000 else [(1, v, v * v, v) for v in sorted(xs)]
    while len(parts) > bins:
        pairs = [tuple(a + b for a, b in zip(parts[i][:3], parts[i + 1][:3])) + (parts[i][3],) for i in range(0, len(parts) - 1, 2)]
        errors = [q - s * s / n for n, s, q, _ in pairs]
        apart = max(0, min(bins // 2 - len(parts) % 2, len(pairs) - 1))
        worst = set(sorted(range(len(pairs)), key=lambda i: (-errors[i], i))[:apart])
        parts = [p for i, pair in enumerate(pairs) for p in (parts[2 * i : 2 * i + 2] if i in worst else [pair])] + parts[2 * len(pairs) :]
    return tuple(sorted({p[3] for p in parts[1:]}))


@pytest.mark.parametrize("local,chunk", [(1 << 17, 1 << 16), (3000, 500)])
def test_least_squares_starts_from_single_values(spark, monkeypatch, local, chunk):
    monkeypatch.setattr(quantize, "LOCAL", local)
    monkeypatch.setattr(quantize, "CHUNK", chunk)
    xs = np.exp(np.random.default_rng(1).normal(size=100_000) * 1.5)
    assert len(set(xs.tolist())) == 100_000
    df = spark.createDataFrame(pd.DataFrame({"value": xs})).repartition(4)
    assert quantize.least_squares(df, "value", 16).splits == plain_least_squares(xs.tolist(), 16)


def test_quantizers_by_group(spark, monkeypatch):
    monkeypatch.setattr(quantize, "LOCAL", 40)
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=300).tolist(), 1: [4.0] * 70, 2: rng.integers(-5, 6, 200).astype(float).tolist(), 3: [1.0], 4: (-np.abs(rng.normal(size=41))).tolist()}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [(2, None)], "worker int, value double")
    for kind in quantize.FITS:
        got = {r.worker: r for r in quantize.fit_by(kind, df, "value", "worker", 16).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            want = quantize.fit(kind, spark.createDataFrame([(x,) for x in xs], "value double"), "value", 16)
            assert (tuple(got[g].splits), got[g].least, got[g].greatest) == (want.splits, want.least, want.greatest)
            if kind == "least_squares":
                assert want.splits == plain_least_squares(xs, 16)
    with pytest.raises(ValueError):
        quantize.fit_by("other", df, "value", "worker")


def test_ranks_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(v)) for g, v in zip(rng.integers(0, 4, 800), rng.integers(0, 60, 800))] + [(9, 7)] * 300
    got = {(r.g, r.v): (r.n, r.before, r.nth, r.s, r.s_before, r.total, r.distinct) for r in ranks.cumulative_by(spark.createDataFrame(rows, "g int, v long").withColumnRenamed("v", "x"), "x", "g", {"s": F.col("x")}, bucket_values=10).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted(v for h, v in rows if h == g)
        for i, v in enumerate(sorted(set(own))):
            want[g, v] = (own.count(v), own.index(v), i, v * own.count(v), sum(x for x in own if x < v), len(own), len(set(own)))
    assert got == want


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("codec", ["quantile", "least_squares", "sketch", "fixed_point"])
def test_jobs_do_not_depend_on_workers(spark, codec):
    g = lambda n: spark.range(n * 60).select((F.col("id") % n).cast("int").alias("worker"), (F.col("id") * 3).alias("key"), F.sin("id").alias("g"))
    s = glm.Settings(codec=codec, bins=16)
    few, many = (jobs(spark, f"{codec}-{n}", lambda n=n: glm.coded(g(n), s).collect()) for n in (2, 12))
    assert many <= few + 2  # adaptive plans differ by a stage or so, not by worker


def test_rounding_bits_go_by_key(spark):
    rows = [(w, k, v) for w, scale in ((0, 1.0), (1, 3.0)) for k, v in ((3, 0.5 * scale), (10, -0.21 * scale), (11, 0.7 * scale), (40, 0.01 * scale))]
    got = {(r.worker, r.key): r.g for r in glm.coded(spark.createDataFrame(rows, "worker int, key long, g double"), glm.Settings(codec="fixed_point")).collect()}
    for w in (0, 1):
        one = codecs.fixed_point(spark.createDataFrame([(k, v) for u, k, v in rows if u == w], "key long, value double"), 8)
        assert {k: v for (u, k), v in got.items() if u == w} == {r.key: r.decoded for r in one.collect()}


def test_many_splits(spark):
    rng = np.random.default_rng(5)
    splits = tuple(np.unique(rng.normal(size=65_535)).tolist())
    q = quantize.Quantizer(splits, -9.0, 9.0)
    xs = np.concatenate([rng.normal(size=500), splits[:3], [-10.0, 10.0]])
    rows = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double").select("x", q.bin(F.col("x")).alias("b")).withColumn("d", q.decoded(F.col("b"))).collect()
    bins = np.searchsorted(splits, xs, side="right")
    by = {r.x: (r.b, r.d) for r in rows}
    assert by.pop(None) == (None, None)
    assert by == {float(x): (int(b), q.values[b]) for x, b in zip(xs, bins)}
    small = quantize.Quantizer((0.0, 1.0), -1.0, 2.0)
    assert [r.v for r in spark.range(5).select(small.decoded(F.col("id") - 1).alias("v")).collect()] == [None, -0.5, 0.5, 1.5, None]
    assert vectors.LITERALS < 65_535


def scanned(df):
    """Rows that the file scans of a plan gave."""
    df.collect()
    found, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().length())]
    return found


def test_batches_read_their_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(glm, "STRETCHES", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = glm.dealt(spark.range(0, 6000, 2).select(F.col("id").alias("id"), F.lit(1.0).alias("y")), "id", 3)
        with Scratch(spark) as scratch:
            held = glm.Held.store(dealt, f"{scratch.folder}/rows", 0.1)
            for b in (0, 3, 9, 10, 17):
                batch = held.batch(b, 0.1)
                assert sorted(r.id for r in batch.select("id").collect()) == sorted(r.id for r in glm.batch(dealt, b, 0.1).select("id").collect())
                assert scanned(held.batch(b, 0.1).select("id", "pos", "size")) <= 1.3 * 0.1 * 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def points(spark, n=240, d=5):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    y = np.sign(x @ np.array([1.0, -2.0, 0.5, 0.0, 1.0]))
    return spark.createDataFrame([(i, float(y[i]), [float(v) for v in x[i]]) for i in range(n)], "id long, y double, x array<double>")


@pytest.mark.parametrize("optimizer", ["adam", "sgd"])
def test_a_run_that_stopped_goes_on(spark, tmp_path, optimizer):
    df, s = points(spark), lambda n: glm.Settings(epochs=n, batch_ratio=0.5, workers=2, optimizer=optimizer)
    whole, history = glm.fit(df, s(3), path=str(tmp_path / "whole"))
    glm.fit(df, s(1), path=str(tmp_path / "run"))
    again, found = glm.fit(df, s(3), path=str(tmp_path / "run"))
    assert again == pytest.approx(whole, rel=1e-12) and np.array(found) == pytest.approx(np.array(history), rel=1e-12)
    assert all(0 <= h[4] <= 1 for h in found)
    losses = {r.epoch: r.loss for r in glm.kept_losses(spark, str(tmp_path / "run")).collect()}
    assert losses == pytest.approx({h[0]: h[1] for h in history})
    assert glm.fit(df, s(3), path=str(tmp_path / "run"))[1] == found  # nothing left to do


def sparse_rows(spark, n=200, keys=30):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        k = sorted(rng.choice(np.arange(1, keys), 3, replace=False).tolist())
        rows.append((i, 1.0 if min(k) < 8 else -1.0, [0, *k] if i % 50 else [], [1.0, *rng.normal(size=3).tolist()] if i % 50 else []))
    return spark.createDataFrame(rows, "id long, y double, idx array<int>, x array<double>")


@pytest.mark.parametrize("changes", [{}, {"optimizer": "sgd", "reg_l1": 0.01}, {"codec": "fixed_point", "algo": "square", "per_step_powers": True}])
def test_parameter_table_equals_an_array(spark, tmp_path, monkeypatch, changes):
    monkeypatch.setattr(params, "HOT", 8)
    df, s = sparse_rows(spark), glm.Settings(epochs=1 if changes else 2, batch_ratio=0.5, workers=2, **changes)
    for dim in (400,) if changes else (30,):  # a gradient of few places is sparse, one of most is dense
        w, history = glm.fit(df, s, dim=dim)
        table, found = params.fit(df, s, dim, str(tmp_path / f"{dim}"))
        mine = {r.key: r.w for r in table.collect()}
        assert [mine.get(k, 0.0) for k in range(dim)] == pytest.approx(w.tolist(), abs=1e-9)
        assert np.array(found) == pytest.approx(np.array(history), abs=1e-9)


def test_two_million_keys_never_reach_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("a table came to the driver"))
    n = 500_000
    idx = F.array(*((F.col("id") * 4 + k).cast("int") for k in range(4)), F.lit(4 * n))
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("y"), idx.alias("idx"), F.array(*[F.lit(1.0)] * 5).alias("x"))
    table, history = params.fit(df, glm.Settings(epochs=1, batch_ratio=1.0, workers=2, reg_l2=0.0, valid_ratio=0.0), 1 << 31, str(tmp_path / "run"))
    r = table.agg(F.count("*").alias("n"), F.count_if((F.col("key") % 8 < 4) == (F.col("w") > 0)).alias("right")).first()
    assert r.n == 4 * n + 1 and r.right >= 4 * n and len(history) == 1
    assert table.where(f"key = {4 * n}").count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_places_are_a_permutation(spark, n):
    df = spark.range(n).withColumnRenamed("id", "pos")
    for seed in (7, 8):
        got = {r.pos: r.place for r in order.shuffled_places(df, "pos", n, seed).collect()}
        assert sorted(got.values()) == list(range(n))
        if n == 1000:
            ranks_ = np.array([got[i] for i in range(n)])
            assert abs(np.corrcoef(np.arange(n), ranks_)[0, 1]) < 0.1 and (np.diff(ranks_) == 1).sum() < 10
    if n == 1000:
        assert got != {r.pos: r.place for r in order.shuffled_places(df, "pos", n, 7).collect()}


def test_a_thousand_vectors_in_one_table(spark, tmp_path):
    rng = np.random.default_rng(9)
    n = 1000
    rows = pd.DataFrame({"vec": np.repeat(np.arange(n), 12), "key": np.concatenate([rng.choice(2**40, 12, replace=False) for _ in range(n)]), "value": rng.normal(size=12 * n)})
    rows.loc[rows["vec"] == 7, "value"] = 3.0
    df = spark.createDataFrame(rows).repartition(4)
    for many, one, kind in ((compressors.compress_dense_many, compressors.compress_dense, compressors.DenseVectors), (compressors.compress_sparse_many, compressors.compress_sparse, compressors.SparseVectors)):
        many(df, bins=8).times(F.when(F.col("vec") == 3, -2.0).otherwise(1.0)).save(str(tmp_path / kind.__name__))
        coded = kind.open(spark, str(tmp_path / kind.__name__), 8)
        back = {(r.vec, r.key): r.value for r in coded.decompress().collect()}
        assert set(back) == set(zip(rows["vec"].tolist(), rows["key"].tolist()))
        for v in (0, 3, 7, 999):
            alone = {r.key: r.value for r in one(df.where(F.col("vec") == v).select("key", "value"), bins=8).times(-2.0 if v == 3 else 1.0).decompress().collect()}
            assert {k: x for (u, k), x in back.items() if u == v} == alone
        total = {r.key: r.value for r in coded.summed().collect()}
        want = {}
        for (_, k), x in back.items():
            want[k] = want.get(k, 0.0) + x
        assert total == pytest.approx(want)


def test_far_keys_of_a_vector_share_a_stretch(spark, monkeypatch):
    """A stretch of few keys isn't cut where they lie far apart; a vector of more keys than a stretch may have still is."""
    rows = [(v, 70_000 * k, 1.0 + k % 3) for v in range(3) for k in range(12)] + [(9, k, 1.0 + k % 3) for k in range(40)]
    df = spark.createDataFrame(rows, "vec long, key long, value double")
    coded = compressors.compress_sparse_many(df, bins=4)
    groups = coded.sizes.where("vec < 9").count()
    assert coded.keys.where("not group like '9/%'").count() == groups < 36
    assert sorted((r.vec, r.key) for r in coded.decompress().collect()) == [(v, k) for v, k, _ in rows]
    monkeypatch.setattr(compressors, "STRETCH", 16)
    cut = compressors.compress_sparse_many(df, bins=4)
    assert cut.keys.where("group like '9/%'").agg({"n": "max"}).first()[0] <= 16 and cut.keys.where("not group like '9/%'").count() == groups
    assert sorted((r.vec, r.key) for r in cut.decompress().collect()) == [(v, k) for v, k, _ in rows]
