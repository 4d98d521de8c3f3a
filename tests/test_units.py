"""Hand-sized cases."""

import math
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantaloom.functions import bits, hashes, losses, vectors
from quantaloom.operators import codecs, compressors, delta, glm, huffman, metrics, minmax, order, quantiles, quantize, ranks
from quantaloom.sources import text
from quantaloom.sources.shared import shared_checkpoint_dir
from quantaloom.streaming.windows import read_stream, window_sketches


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "value double")


def vector(spark, xs):
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(xs)], "key long, value double")


def test_even_quantiles(spark):
    assert [(r.rank, r.value) for r in quantiles.even_quantiles(values(spark, range(1, 9)), "value", 4).orderBy("i").collect()] == [(2, 3.0), (4, 5.0), (6, 7.0)]
    assert quantiles.quantiles(values(spark, [1, 2, 3, 4]), "value", [0.5]).first().value == 3.0
    with pytest.raises(ValueError):
        quantiles.even_quantiles(values(spark, [1]), "value", 1)
    with pytest.raises(ValueError):
        quantiles.quantiles(values(spark, [1]), "value", [1.5])
    assert quantiles.even_quantiles(values(spark, []), "value", 4).count() == 0


def test_ranks_with_one_hot_value(spark):
    xs = [5.0] * 500 + list(range(100))
    got = {r.i: r.value for r in quantiles.even_quantiles(values(spark, xs), "value", 16).collect()}
    ordered = sorted(xs)
    assert got == {i: ordered[len(xs) * i // 16] for i in range(1, 16)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_ranks_property(spark, xs):
    ranked = ranks.cumulative(values(spark, xs), "value").collect()
    ordered = sorted(xs)
    assert {r.v: (r.n, r.before) for r in ranked} == {float(x): (ordered.count(x), ordered.index(x)) for x in set(xs)}


def test_bins_and_midpoints(spark):
    q = quantize.Quantizer((3.0, 5.0, 7.0), 1.0, 8.0)
    got = values(spark, [2, 3, 6.9, 7]).select(q.bin(F.col("value")).alias("b")).collect()
    assert [r.b for r in got] == [0, 1, 2, 3]
    assert q.values == (2.0, 4.0, 6.0, 7.5)
    assert quantize.Quantizer((-1.0, 0.0, 1.0), -2.0, 2.0).zero == 1
    assert quantize.Quantizer((-3.0,), -4.0, -1.0).zero == 1


@pytest.mark.parametrize("kind", ["uniform", "quantile", "least_squares"])
def test_quantizers_on_awkward_values(spark, kind):
    for xs in ([4.0] * 50, [0.0] * 90 + list(np.linspace(-1, 1, 11)), [1.0], list(range(300))):
        q = quantize.fit(kind, values(spark, xs), "value", 16)
        back = values(spark, xs).select("value", q.decoded(q.bin(F.col("value"))).alias("d")).collect()
        assert q.bins <= 17
        assert all(q.least <= r.d <= q.greatest for r in back)


def test_least_squares_beats_uniform_on_skew(spark):
    rng = np.random.default_rng(1)
    df = values(spark, np.exp(rng.normal(size=3000) * 1.5))
    errors = {}
    for kind in ("uniform", "least_squares"):
        q = quantize.fit(kind, df, "value", 16)
        errors[kind] = df.select(F.sum((F.col("value") - q.decoded(q.bin(F.col("value")))) ** 2)).first()[0]
    assert errors["least_squares"] < errors["uniform"]


def test_nan_is_refused(spark):
    with pytest.raises(ValueError):
        quantize.uniform(values(spark, [1.0, float("nan")]), "value")


@pytest.mark.parametrize("zero,bins,groups,edges", [(128, 256, 8, [32, 64, 96, 128, 160, 192, 224, 256]), (250, 256, 8, [26, 58, 90, 122, 154, 186, 218, 256]), (5, 20, 2, [5, 20]), (0, 3, 8, [0, 1, 3])])
def test_group_edges(zero, bins, groups, edges):
    assert minmax.group_edges(zero, bins, groups) == edges


def test_minmax_keeps_the_nearer(spark):
    pairs = spark.createDataFrame([(0, 1, 5), (0, 2, 3)], "group int, key long, bin int")
    cells, sizes = minmax.build(pairs, 0, rows=1, ratio=0.5)
    assert sizes.first().columns == 1
    assert {r.bin for r in minmax.restore(pairs.select("group", "key"), cells, sizes, 0, 1).collect()} == {3}


def reference_hash(name, key, size):
    """Signed 32-bit arithmetic by numpy."""
    with np.errstate(over="ignore"):
        x = np.int32(key)
        s = lambda v: np.int64(v).astype(np.int32)
        for step in hashes.ROUNDS[name]:
            def term(t):
                if isinstance(t[0], tuple):
                    return joined(t)
                return {"x": lambda: x, "not": lambda: ~x, "const": lambda: s(hashes._signed(t[1])), "shl": lambda: s(np.int64(x) << t[1]), "shr": lambda: x >> np.int32(t[1])}[t[0]]()

            def joined(t):
                if t[0] == "mul":
                    return s(np.int64(x) * t[1])
                return term(t[0]) + term(t[2]) if t[1] == "+" else term(t[0]) ^ term(t[2])

            x = joined(step)
        return int(x) % size


@pytest.mark.parametrize("name", list(hashes.ROUNDS))
def test_hashes(spark, name):
    keys = [0, 1, 2, 255, 65536, 2**31 - 1, 123456789, -7]
    got = spark.createDataFrame([(k,) for k in keys], "key long").select("key", hashes.hashed(name, F.col("key"), 1009).alias("h")).collect()
    assert {r.key: r.h for r in got} == {k: reference_hash(name, k, 1009) for k in keys}


def test_digit_hash_and_order(spark):
    got = spark.createDataFrame([(0,), (12,)], "key long").select(hashes.digit_hashed(31, F.col("key"), 1000).alias("h")).collect()
    assert [r.h for r in got] == [0, 31 * 2 + 1]
    with pytest.raises(ValueError):
        hashes.first_hashes(9)


def test_bits(spark):
    row = spark.range(1).select(bits.log2_floor(F.lit(8)).alias("a"), bits.is_power_of_two(F.lit(65536)).alias("b"), bits.needed_bytes(F.lit(70000)).alias("c"), bits.number_of(bits.bits_of(F.lit(5), 8)).alias("d")).first()
    assert tuple(row) == (3, False, 4, 5)


def test_delta(spark):
    df = spark.createDataFrame([(0, k) for k in (0, 3, 4, 260)], "group int, key long")
    g = delta.gaps(df).orderBy("key").collect()
    assert [(r.gap, r.bits) for r in g] == [(0, 1), (3, 2), (1, 1), (256, 9)]
    assert [r.key for r in delta.decode(delta.encode(delta.gaps(df))).orderBy("pos").collect()] == [0, 3, 4, 260]
    assert delta.byte_sizes(delta.gaps(df)).first().total_bits == 4 * 2 + 8 * (1 + 1 + 1 + 2)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 1_000_000), min_size=1, max_size=80))
def test_delta_roundtrip(spark, keys):
    df = spark.createDataFrame([(k % 3, k) for k in keys], "group int, key long")
    assert {r.key for r in delta.decode(delta.encode(delta.gaps(df))).collect()} == keys


def test_huffman():
    code = huffman.Code([(1, 5), (2, 2), (3, 1), (4, 1)]).bits
    assert [len(code[v]) for v in (1, 2, 3, 4)] == [1, 2, 3, 3]
    assert not any(a != b and b.startswith(a) for a in code.values() for b in code.values())
    assert huffman.Code([(9, 4)]).bits == {9: "0"}


def test_fixed_point(spark):
    r = codecs.with_norm(vector(spark, [3, -4])).select("norm", codecs.fixed_code(F.col("value"), F.col("norm"), 8, F.lit(0)).alias("c")).orderBy("c").collect()
    assert r[0].norm == 5.0
    assert [x.c for x in r] == [76, 128 + 101]
    zero = codecs.fixed_point(vector(spark, [0.0, 0.0])).collect()
    assert len(zero) == 2


def test_codecs_and_report(spark):
    df = vector(spark, np.random.default_rng(2).normal(size=400))
    found = {r.codec: r for r in codecs.report(df).collect()}
    assert found["none"].rmse == 0 and found["float"].rmse < 1e-6
    assert all(found[k].cosine > 0.99 for k in ("uniform", "quantile", "least_squares"))
    with pytest.raises(ValueError):
        codecs.run("other", df)


def test_report_has_every_codec(spark):
    found = {r.codec: r for r in codecs.report(vector(spark, np.random.default_rng(2).normal(size=400))).collect()}
    assert set(found) == set(codecs.CODECS)
    assert found["sketch"].n == 400 and found["quantile"].rmse <= found["sketch"].rmse < 1


@pytest.mark.parametrize("codec", ["least_squares", "sketch"])
def test_gradients_by_codecs_that_are_jobs(spark, codec):
    """Worker by worker the same as the column codec; a dense gradient keeps its quantile bins, a sparse one is sketched."""
    rng, s = np.random.default_rng(4), glm.Settings(codec=codec, bins=16)
    held = {0: {k: float(rng.normal()) for k in range(90)}, 1: {k: float(rng.normal()) for k in range(0, 90, 3)}}
    df = spark.createDataFrame([(w, k, v) for w, g in held.items() for k, v in g.items()], "worker int, key int, g double")
    got = {(r.worker, r.key): r.g for r in glm.coded(df, s, 90).collect()}
    for w, g in held.items():
        one = spark.createDataFrame(list(g.items()), "key int, value double")
        want = codecs.quantized(one, "least_squares", 16) if codec == "least_squares" else codecs.quantized(one, "quantile", 16) if w == 0 else codecs.sketched(one, "quantile", 16)
        assert {k: v for (u, k), v in got.items() if u == w} == {r.key: r.decoded for r in want.collect()}
    assert glm.coded(df.where("false"), s).count() == 0


@pytest.mark.parametrize("codec", ["least_squares", "sketch"])
def test_training_with_codecs_that_are_jobs(spark, codec):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    y = np.sign(x @ np.array([1.0, -2.0, 0.5, 0.0, 1.0]))
    df = spark.createDataFrame([(i, float(y[i]), [float(v) for v in x[i]]) for i in range(200)], "id long, y double, x array<double>")
    w, history = glm.fit(df, glm.Settings(codec=codec, epochs=2, batch_ratio=0.5, reg_l2=0.001, workers=2))
    assert len(w) == 5 and history[-1][1] < history[0][1]


def test_losses(spark):
    at = lambda f, z: spark.range(1).select(f(F.lit(float(z)), F.lit(1.0))).first()[0]
    assert at(losses.log_loss, 20) == pytest.approx(math.exp(-20)) and at(losses.log_loss, -20) == 20 and at(losses.log_loss, 0) == pytest.approx(math.log(2))
    assert at(losses.hinge_loss, 1) == 0 and at(losses.hinge_pull, 1) == 1
    assert at(losses.square_loss, 3) == 2 and at(losses.square_pull, 3) == -2


def test_sparse_vectors(spark):
    a, b, none = vector(spark, [1, 0, 2]), spark.createDataFrame([(2, 3.0), (5, 1.0)], "key long, value double"), spark.createDataFrame([], "key long, value double")
    assert vectors.sparse_dot(a, b).first().dot == 6.0 and vectors.sparse_dot(a, none).first().dot == 0.0
    assert {r.key: r.value for r in vectors.sparse_add(a, b).collect()} == {0: 1.0, 1: 0.0, 2: 5.0, 5: 1.0}
    assert [r.value for r in vectors.dense(b, 4).orderBy("key").collect()] == [0.0, 0.0, 3.0, 0.0]
    assert vectors.format_choice(a, 3).first().format == "sparse"
    assert vectors.sparse(none).count() == 0


def test_order(spark):
    row = spark.range(1).select(order.argmax_first(F.array(F.lit(1), F.lit(9), F.lit(9))).alias("a"), order.unique_sorted(F.array(F.lit(2), F.lit(1), F.lit(2))).alias("u")).first()
    assert row.a == 1 and row.u == [1, 2]
    assert ranks.kth_largest(values(spark, [5, 1, 4, 2, 3]), "value", 2).first().value == 4.0
    with pytest.raises(ValueError):
        ranks.kth_smallest(values(spark, [1]), "value", 0)


def test_metrics(spark):
    df = spark.createDataFrame([(2.0, 1.0), (-1.0, -1.0), (0.5, -1.0), (0.0, 1.0)], "score double, y double")
    c = metrics.confusion(df, losses.hinge_loss(F.col("score"), F.col("y"))).first()
    assert (c.tp, c.tn, c.fp, c.fn, c.n) == (1, 1, 1, 0, 4)
    assert metrics.auc(df).first().auc == pytest.approx(3 / 4)
    assert metrics.auc(df.where("y > 0")).first().auc is None


def test_parsers(spark):
    lines = spark.createDataFrame([("1 3:0.5  7:2",), ("",), ("0 1:1",)], "value string")
    rows = text.parse(lines, "libsvm").collect()
    assert [(r.label, r.idx, r.val) for r in rows] == [(1.0, [3, 7], [0.5, 2.0]), (-1.0, [1], [1.0])]
    assert text.parse(spark.createDataFrame([("2,1.5,3",)], "value string"), "csv", negative=False).first().features == [1.5, 3.0]
    assert text.parse(spark.createDataFrame([("1,4,9",)], "value string"), "dummy").first().idx == [4, 9]
    with pytest.raises(ValueError):
        text.parse(lines, "json")


def test_text_source_and_narrow_bins(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0:1 2:3\n0 1:2\n")
    assert text.load(spark, str(tmp_path / "a.txt"), "libsvm", 2).count() == 2
    rows = spark.createDataFrame([(0,), (255,)], "bin int")
    small = text.narrow_bins(rows, 256)
    assert dict(small.dtypes)["bin"] == "tinyint"
    text.save(small, str(tmp_path / "bins"))
    assert {r.bin for r in text.wide_bins(spark.read.parquet(str(tmp_path / "bins")), 256).collect()} == {0, 255}


def test_adam_powers():
    """Powers move once an epoch of ten batches: 1 for updates 1-9, 2 for 10-19, 3 for 20."""
    s, state, powers = glm.Settings(), glm.State(np.zeros(2)), []
    for t in range(1, 21):
        state.adam(np.array([0]), np.array([1.0]), s, t % 10 == 0)
        powers.append(round(math.log(state.b1) / math.log(0.9)))
    assert powers == [1] * 9 + [2] * 10 + [3]
    assert state.w[1] == 0


@pytest.mark.parametrize("algo,codec", [("logistic", "none"), ("hinge", "quantile"), ("square", "fixed_point")])
def test_training_lowers_the_loss(spark, algo, codec):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = np.sign(x @ np.array([1.0, -2.0, 0.5, 0.0, 1.0]))
    df = spark.createDataFrame([(i, float(y[i]), [float(v) for v in x[i]]) for i in range(400)], "id long, y double, x array<double>")
    w, history = glm.fit(df, glm.Settings(algo=algo, codec=codec, epochs=2, batch_ratio=0.34, reg_l2=0.001, workers=2))
    assert history[-1][1] < history[0][1] and history[-1][3] > 0.8
    assert len(w) == 5


def test_settings_are_checked():
    for bad in ({"algo": "tree"}, {"codec": "zip9"}, {"optimizer": "newton"}):
        with pytest.raises(ValueError):
            glm.Settings(**bad)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = window_sketches(read_stream(spark, str(tmp_path / "in"), events.schema), late="10000 days").drop("sketch")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, window_sketches(events).drop("sketch").collect()))


def test_compressors(spark):
    rng = np.random.default_rng(5)
    keys = np.sort(rng.choice(100_000, 600, replace=False))
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, rng.normal(size=600), strict=True)], "key long, value double")
    dense = compressors.compress_dense(df, "uniform", 64)
    assert {r.key for r in dense.times(2.0).decompress().collect()} == set(keys.tolist())
    assert dense.memory_bytes() < 12 * 600
    sparse = compressors.compress_sparse(df, bins=64)
    back = {r.key: r.value for r in sparse.decompress().collect()}
    was = {r.key: r.value for r in df.collect()}
    assert back.keys() == was.keys()
    zero = sparse.quantizer.values[sparse.quantizer.zero]
    assert np.mean([abs(back[k] - zero) <= abs(was[k] - zero) + 0.5 for k in was]) > 0.95
    assert sparse.decompress_dense(100_000).count() == 100_000
    assert {r.key: r.value for r in sparse.times(-0.5).decompress().collect()} == {k: -0.5 * v for k, v in back.items()}


def test_settings_from_the_session(spark):
    spark.conf.set("spark.quantaloom.algo", "hinge")
    spark.conf.set("spark.quantaloom.epochs", "3")
    s = glm.Settings.from_conf(spark)
    assert (s.algo, s.epochs, s.learn_rate) == ("hinge", 3, 0.1)
    spark.conf.unset("spark.quantaloom.algo")
    spark.conf.unset("spark.quantaloom.epochs")


def test_dense_takes_its_length_from_the_data(spark):
    df = spark.createDataFrame([(3, 1.5), (7000, 0.0)], "key long, value double")
    got = {r.key: r.value for r in vectors.dense(df).collect()}
    assert got == {k: 1.5 if k == 3 else 0.0 for k in range(7001)}
    assert vectors.dense(df.where("false")).count() == 0


def test_whole_gradient_takes_every_row(spark, tmp_path):
    from quantaloom.plans.model_queries import L2, WEIGHTS
    from quantaloom.plans.registry import QUERIES

    rows = [(1, 25, "F", 1e6), (2, 39, "O", 2e6), (3, 3, "F", 5e5)]  # customers 25 and 39 lie outside the old filter
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    for order, customer, status, price in rows:
        y, x = 1.0 if status == "F" else -1.0, {customer % 20: 1.0, 40 + order % 5: price / 1e6}
        pull = y / (math.exp(y * sum(WEIGHTS[k] * v for k, v in x.items())) + 1)
        for k, v in x.items():
            want[k] = want.get(k, 0.0) - pull * v / len(rows)
    got = {r.key: r.g for r in QUERIES["sparse_gradient_step_whole"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({k: v + L2 * WEIGHTS[k] for k, v in want.items()}, abs=1e-8)


def test_whole_adam_step_takes_every_line(spark, tmp_path):
    from quantaloom.plans.registry import QUERIES

    spark.createDataFrame([(1, 0.0), (2, 0.1), (2, 0.1), (4, 0.0)], "l_linenumber int, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.key: r.w for r in QUERIES["adam_sparse_step_whole"](spark, str(tmp_path)).collect()}
    assert len(got) == 16 and {k: math.copysign(1, 1 - w) for k, w in got.items() if w != 1} == {2: -1.0, 4: 1.0, 8: -1.0}


def test_sparse_training(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        k = int(rng.integers(0, 9))
        rows.append((i, 1.0 if k < 4 else -1.0, [k, 9], [1.0, 0.1]))
    df = spark.createDataFrame(rows, "id long, y double, idx array<int>, x array<double>")
    w, history = glm.fit(df, glm.Settings(epochs=2, batch_ratio=0.5, reg_l2=0.0, workers=2, learn_rate=0.3), dim=40)
    assert history[-1][3] > 0.95 and (w[:4] > 0).all() and (w[4:9] < 0).all() and (w[10:] == 0).all()
    dense = spark.createDataFrame([(0, k, 1.0) for k in range(3)], "worker int, key int, g double")
    assert glm.active(dense, 4).count() == 4 and glm.active(dense, 9).count() == 3


def _wrapped(x):
    return (x + (1 << 31)) % (1 << 32) - (1 << 31)


def _jenkins(a):
    """Written out, apart from the library's table."""
    a = _wrapped(_wrapped(a + 0x7ED55D16) + (a << 12))
    a = _wrapped((a ^ 0xC761C23C) ^ (a >> 19))
    a = _wrapped(_wrapped(a + 0x165667B1) + (a << 5))
    a = _wrapped(_wrapped(a + 0xD3A2646C) ^ _wrapped(a << 9))
    a = _wrapped(_wrapped(a + 0xFD7046C5) + (a << 3))
    return _wrapped((a ^ 0xB55A4F09) ^ (a >> 16))


def _wang_64(a):
    a = _wrapped(~a + (a << 21))
    a ^= a >> 24
    a = _wrapped(a + (a << 3) + (a << 8))
    a ^= a >> 14
    a = _wrapped(a + (a << 2) + (a << 4))
    a ^= a >> 28
    return _wrapped(a + (a << 31))


def _wang_32(a):
    a = _wrapped(~a + (a << 15))
    a ^= a >> 12
    a = _wrapped(a + (a << 2))
    a ^= a >> 4
    a = _wrapped(a * 2057)
    return _wrapped(a ^ (a >> 16))


@pytest.mark.parametrize(("name", "plain"), [("bj", _jenkins), ("mix64", _wang_64), ("tw", _wang_32)])
def test_hashes_written_out(spark, name, plain):
    keys = [0, 1, 2, 7, 12345, 2**31 - 1, -1, -98765]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", hashes.hashed(name, F.col("k"), 1009).alias("h")).collect()
    assert {r.k: r.h for r in got} == {k: plain(k) % 1009 for k in keys}


def test_coded_vectors_are_stored_and_opened(spark, tmp_path):
    df = spark.createDataFrame([(k * 3, ((k * 37) % 101 - 50) / 7.0) for k in range(200)], "key long, value double")
    for name, coded in (("dense", compressors.compress_dense(df, bins=16).times(2.0)), ("sparse", compressors.compress_sparse(df, bins=16))):
        coded.save(str(tmp_path / name))
        back = compressors.open_vector(spark, str(tmp_path / name))
        assert back.quantizer == coded.quantizer and back.scale == coded.scale
        assert sorted(map(tuple, back.decompress().collect())) == sorted(map(tuple, coded.decompress().collect()))
        assert back.memory_bytes() == coded.memory_bytes()


def test_byte_code(spark):
    keys = [(0, k) for k in (0, 3, 4, 260, 70000, 2**31)] + [(5, 9)]
    coded = delta.encode_bytes(delta.gaps(spark.createDataFrame(keys, "group long, key long")))
    payload = {r.group: bytes(r.payload) for r in coded.collect()}
    # flags 00 00 00 01 10 10, filled up to two bytes
    assert payload[0] == bytes([0b00000001, 0b10100000, 0, 3, 1, 1, 0]) + (70000 - 260).to_bytes(4, "big") + (2**31 - 70000).to_bytes(4, "big")
    assert payload[5] == bytes([0, 9])
    assert sorted((r.group, r.key) for r in delta.decode_bytes(coded).collect()) == sorted(keys)


def test_sketch_refuses_nan_and_odd_k(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="values must be numbers"):
        quantiles.sketches(df, "x").collect()
    with pytest.raises(ValueError, match="power of two"):
        quantiles.sketches(df, "x", k=100)


def test_places_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(glm, "RANGE_ROWS", 10)
    rows = spark.range(0, 3000, 7).withColumnRenamed("id", "i").select("i")
    got = sorted((r.worker, r.i, r.pos, r.size) for r in glm.dealt(rows, "i", 3).collect())
    by = {}
    for i in range(0, 3000, 7):
        by.setdefault(i % 3, []).append(i)
    assert got == sorted((w, i, k, len(ids)) for w, ids in by.items() for k, i in enumerate(ids))
    ranked = ranks.cumulative(rows, "i", bucket_values=10)
    assert sorted((r.v, r.before) for r in ranked.collect()) == [(i, k) for k, i in enumerate(range(0, 3000, 7))]


def test_long_models_are_scored_by_array(spark, monkeypatch):
    w = np.arange(6) / 3.0
    dense = spark.createDataFrame([(1, [1.0, 0.0, 2.0, 0.0, 0.0, 3.0]), (2, [0.5] * 6)], "id long, x array<double>")
    thin = spark.createDataFrame([(1, [0, 5], [2.0, 1.0]), (2, [3], [4.0])], "id long, idx array<int>, x array<double>")
    g = spark.createDataFrame([(0, 2, 0.5), (1, 5, 0.25)], "worker int, key int, g double")
    plain = [[r.score for r in glm.scored(df, w).orderBy("id").collect()] for df in (dense, thin)] + [sorted(map(tuple, glm.with_l2(g, w, 0.1).collect()))]
    monkeypatch.setattr(glm, "LITERALS", 3)
    wide = [[r.score for r in glm.scored(df, w).orderBy("id").collect()] for df in (dense, thin)] + [sorted(map(tuple, glm.with_l2(g, w, 0.1).collect()))]
    assert wide[:2] == [pytest.approx(p) for p in plain[:2]] and wide[2] == plain[2]


def test_both_penalties_enter_the_loss():
    w = np.array([3.0, -4.0])
    assert glm.penalty(w, glm.Settings(reg_l1=0.5, reg_l2=0.0)) == 3.5
    assert glm.penalty(w, glm.Settings(reg_l1=0.5, reg_l2=0.1)) == pytest.approx(4.0)


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))
