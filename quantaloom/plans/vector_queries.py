"""Queries over numeric vectors: formats, quantiles, quantizers, codecs, order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import codecs, compressors, glm, minmax, order, quantiles, quantize, ranks
from .registry import merging_sql, query, table

# ---------------------------------------------------------------- vectors

REVENUE = "sum(l_extendedprice * (1 - l_discount))"


def _revenue(spark, d, flag):
    return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("key")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))


_TWO = f"WITH a AS (SELECT l_partkey AS key, {REVENUE} AS value FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS key, {REVENUE} AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) "


@query("sparse_dot", _TWO + "SELECT round(coalesce(sum(a.value * b.value), 0) / 1e6, 2) AS dot FROM a JOIN b USING (key)")
def sparse_dot(spark, d):
    return vectors.sparse_dot(_revenue(spark, d, "A"), _revenue(spark, d, "R")).select(F.round(F.col("dot") / 1e6, 2).alias("dot"))


@query("sparse_add", _TWO + "SELECT coalesce(a.key, b.key) AS key, round(coalesce(a.value, 0) + coalesce(b.value, 0), 3) AS value FROM a FULL JOIN b ON a.key = b.key")
def sparse_add(spark, d):
    return vectors.sparse_add(_revenue(spark, d, "A"), _revenue(spark, d, "R")).select("key", F.round("value", 3).alias("value"))


@query("vector_scale", _TWO + "SELECT key, round(value * -0.5::DOUBLE, 3) AS value FROM a")
def vector_scale(spark, d):
    return vectors.scaled(_revenue(spark, d, "A"), -0.5).select("key", F.round("value", 3).alias("value"))


def _discounts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_discount").alias("value"))


_DISC = "WITH v AS (SELECT l_orderkey AS key, min(l_discount) AS value FROM lineitem GROUP BY 1) "


@query("dense_to_sparse_eps", _DISC + "SELECT key, value FROM v WHERE abs(value) > 1e-8")
def dense_to_sparse_eps(spark, d):
    return vectors.sparse(_discounts(spark, d))


@query("sparse_to_dense_whole", "SELECT g.i AS key, coalesce(v.value, 0.0::DOUBLE) AS value FROM (SELECT unnest(range(0, (SELECT max(l_orderkey) + 1 FROM lineitem)))::BIGINT AS i) g LEFT JOIN (SELECT l_orderkey AS key, min(l_discount) AS value FROM lineitem GROUP BY 1 HAVING abs(min(l_discount)) > 1e-8) v ON v.key = g.i")
def sparse_to_dense_whole(spark, d):
    return vectors.dense(_discounts(spark, d))


@query("auto_format", _DISC + "SELECT count(*) FILTER (abs(value) > 1e-8) AS nnz, max(key) + 1 AS dim, CASE WHEN count(*) FILTER (abs(value) > 1e-8) > ((max(key) + 1) * 2) // 3 THEN 'dense' ELSE 'sparse' END AS format FROM v")
def auto_format(spark, d):
    v = _discounts(spark, d)
    return vectors.format_choice(v, F.col("key") + 1)


@query("vector_norms", "SELECT round(sum(abs(c_acctbal)), 2) AS l1, round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS l2 FROM customer")
def vector_norms(spark, d):
    return vectors.norms(_balances(spark, d)).select(F.round("l1", 2).alias("l1"), F.round("l2", 4).alias("l2"))


def _balances(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))


@query("float_codec_error", "WITH v AS (SELECT c_acctbal AS x, c_acctbal::FLOAT::DOUBLE AS y FROM customer) SELECT round(sum((x - y) * (x - y)), 6) AS squared_euclidean, round(sqrt(sum((x - y) * (x - y))), 6) AS euclidean, round(sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)), 9) AS cosine FROM v")
def float_codec_error(spark, d):
    found = vectors.distances(codecs.as_float(_balances(spark, d)), "value", "decoded")
    return found.select(F.round("squared_euclidean", 6).alias("squared_euclidean"), F.round("euclidean", 6).alias("euclidean"), F.round("cosine", 9).alias("cosine"))


# ---------------------------------------------------------------- quantiles

_PRICE = "WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem) "


@query("quantile_even", _PRICE + "SELECT i, (n * i) // 64 AS rank, v AS value FROM s JOIN (SELECT unnest(range(1, 64)) AS i) ON r = (n * i) // 64")
def quantile_even(spark, d):
    return quantiles.even_quantiles(table(spark, d, "lineitem"), "l_extendedprice", 64)


@query("quantile_single", _PRICE + "SELECT 0.3::DOUBLE AS fraction, v AS value FROM s WHERE r = floor(n * 0.3::DOUBLE)")
def quantile_single(spark, d):
    return quantiles.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.3])


@query("quantile_array", _PRICE + "SELECT f AS fraction, v AS value FROM s JOIN (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]::DOUBLE[]) AS f) ON r = least(floor(n * f), n - 1)")
def quantile_array(spark, d):
    return quantiles.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])


@query("sketch_scalars", "SELECT count(l_quantity) AS n, min(l_quantity) AS least, max(l_quantity) AS greatest FROM lineitem")
def sketch_scalars(spark, d):
    return quantiles.summary(table(spark, d, "lineitem"), "l_quantity")


@query("weighted_summary_prefix", "WITH g AS (SELECT value, sum(pow(2, event_id % 5))::BIGINT AS weight FROM events GROUP BY value) SELECT value, weight, (sum(weight) OVER (ORDER BY value) - weight)::BIGINT AS before FROM g")
def weighted_summary_prefix(spark, d):
    samples = table(spark, d, "events").select("value", (F.col("event_id") % 5).alias("level"))
    return quantiles.weighted_summary(samples, "value", "level")


@query("kll_quantile_bound", "SELECT f AS fraction, true AS within FROM (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS f)")
def kll_quantile_bound(spark, d):
    rows = table(spark, d, "lineitem")
    found = quantiles.merged_quantiles(quantiles.sketches(rows, "l_extendedprice", ["l_linenumber"], 512), [0.1, 0.25, 0.5, 0.75, 0.9])
    bounds = quantiles.rank_bounds(rows, "l_extendedprice", found)
    return bounds.select("fraction", ((F.col("below") - 0.02 <= F.col("fraction")) & (F.col("fraction") <= F.col("upto") + 0.02)).alias("within"))


@query("quantiles_by_flag_sketch", None)
def quantiles_by_flag_sketch(spark, d):
    return quantiles.sketches(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", "n", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median"))


@query("quantiles_by_flag_bound", "SELECT l_returnflag, count(*) AS n, true AS within FROM lineitem GROUP BY 1")
def quantiles_by_flag_bound(spark, d):
    """Whether the ranks of each group's approximate median enclose a half, within 0.02."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    found = quantiles.sketches(rows, "l_extendedprice", ["l_returnflag"], 512).select("l_returnflag", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("q"))
    met = rows.join(F.broadcast(found), "l_returnflag")  # a row for each flag
    x, q, n = F.col("l_extendedprice"), F.col("q"), F.count("*")
    return met.groupBy("l_returnflag").agg(n.alias("n"), ((F.count_if(x < q) <= 0.52 * n) & (F.count_if(x <= q) >= 0.48 * n)).alias("within"))


# ---------------------------------------------------------------- quantizers

def _split_sql(source: str, value: str, bins: int) -> str:
    """Distinct even splits, the range, the bins of the values."""
    return (
        f"WITH x AS (SELECT {value} AS v FROM {source} WHERE {value} IS NOT NULL), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM x), "
        f"sp AS (SELECT DISTINCT v FROM s JOIN (SELECT unnest(range(1, {bins})) AS i) ON r = (n * i) // {bins}), lim AS (SELECT min(v) AS lo, max(v) AS hi FROM x), "
        "ed AS (SELECT row_number() OVER (ORDER BY v) - 1 AS bin, coalesce(lag(v) OVER (ORDER BY v), lo) AS a, v AS b FROM (SELECT v FROM sp UNION ALL SELECT hi FROM lim) e, lim), "
        "eb AS (SELECT row_number() OVER (ORDER BY k, b) - 1 AS bin, 0.5::DOUBLE * (coalesce(lag(b) OVER (ORDER BY k, b), (SELECT lo FROM lim)) + b) AS mid FROM (SELECT v AS b, 0 AS k FROM sp UNION ALL SELECT hi, 1 FROM lim)), "
        "bn AS (SELECT v, (SELECT count(*) FROM sp WHERE sp.v <= x.v) AS bin FROM x) "
    )


def _binned(df, value, kind, bins):
    q = quantize.fit(kind, df, value, bins)
    rows = df.where(F.col(value).isNotNull()).select(q.bin(F.col(value)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return rows.select("bin", "n", F.round(q.decoded(F.col("bin")), 6).alias("mid"))


_BINS = "SELECT bn.bin, count(*) AS n, round(max(eb.mid), 6) AS mid FROM bn JOIN eb ON bn.bin = eb.bin GROUP BY bn.bin"


@query("quantile_quantize", _split_sql("customer", "c_acctbal", 64) + _BINS)
def quantile_quantize(spark, d):
    return _binned(table(spark, d, "customer"), "c_acctbal", "quantile", 64)


@query("quantile_quantize_dup_shrink", _split_sql("lineitem", "l_quantity", 256) + _BINS)
def quantile_quantize_dup_shrink(spark, d):
    return _binned(table(spark, d, "lineitem"), "l_quantity", "quantile", 256)


_UNI = "WITH lim AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), sp AS (SELECT i, lo + (hi - lo) / 32 * i AS v FROM lim, (SELECT unnest(range(1, 32)) AS i)), bn AS (SELECT (SELECT count(*) FROM sp WHERE v <= c_acctbal) AS bin FROM customer) "


@query("uniform_quantize", _UNI + "SELECT bin, count(*) AS n, round(max(lo + (hi - lo) / 32 * (bin + 0.5::DOUBLE)), 6) AS mid FROM bn, lim GROUP BY bin")
def uniform_quantize(spark, d):
    return _binned(table(spark, d, "customer"), "c_acctbal", "uniform", 32)


@query("zero_index", _split_sql("customer", "c_acctbal", 64) + "SELECT (SELECT count(*) FROM sp WHERE v < 0) AS zero_bin, (SELECT count(*) + 1 FROM sp) AS bins")
def zero_index(spark, d):
    q = quantize.quantile(table(spark, d, "customer"), "c_acctbal", 64)
    return spark.range(1).select(F.lit(q.zero).cast("long").alias("zero_bin"), F.lit(q.bins).cast("long").alias("bins"))


@query("bucket_midpoints", _split_sql("lineitem", "l_discount", 16) + "SELECT bin, round(mid, 6) AS mid FROM eb")
def bucket_midpoints(spark, d):
    q = quantize.quantile(table(spark, d, "lineitem"), "l_discount", 16)
    return spark.createDataFrame(list(enumerate(q.values)), "bin long, mid double").select("bin", F.round("mid", 6).alias("mid"))


@query("zip_prefix_sums", "WITH g AS (SELECT c_acctbal AS v, count(*) AS n, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS q FROM customer GROUP BY 1) SELECT v AS value, (sum(n) OVER w)::BIGINT AS rows, round(sum(s) OVER w, 2) AS sum1, round((sum(q) OVER w) / 1e6, 3) AS sum2 FROM g WINDOW w AS (ORDER BY v)")
def zip_prefix_sums(spark, d):
    found = quantize.prefix_sums(table(spark, d, "customer"), "c_acctbal")
    return found.select("value", "rows", F.round("sum1", 2).alias("sum1"), F.round(F.col("sum2") / 1e6, 3).alias("sum2"))


@query("zip_first_merge_errors", "WITH s AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) - 1 AS r FROM customer) SELECT r // 2 AS pair, count(*) AS n, round(sum(x * x) - sum(x) * sum(x) / count(*), 2) AS error FROM s GROUP BY 1")
def zip_first_merge_errors(spark, d):
    ranked = ranks.cumulative(table(spark, d, "customer"), "c_acctbal")
    rows = ranked.select(F.col("v").alias("x"), F.explode(F.sequence("before", F.col("before") + F.col("n") - 1)).alias("r"))
    x = F.col("x")
    return rows.groupBy(F.expr("r div 2").alias("pair")).agg(F.count("*").alias("n"), F.round(F.sum(x * x) - F.sum(x) * F.sum(x) / F.count("*"), 2).alias("error"))


def _zip_sql(bins: int, end: str = "SELECT zn.bin, count(*) AS n, round(max(zb.mid), 6) AS mid FROM zn JOIN zb ON zn.bin = zb.bin GROUP BY zn.bin") -> str:
    """From single values, merged; then the bins of all values and their midpoints."""
    return (
        "WITH x AS MATERIALIZED (SELECT c_acctbal AS v FROM customer), lim AS (SELECT min(v) AS lo, max(v) AS hi FROM x), "
        "p0 AS (SELECT 0 AS worker, row_number() OVER (ORDER BY v) - 1 AS i, n, n * v AS s, n * v * v AS q, v AS low FROM (SELECT v, count(*)::DOUBLE AS n FROM x GROUP BY v))" + merging_sql(bins, 28)
        + ", zs AS MATERIALIZED (SELECT DISTINCT low AS v FROM p28 WHERE i > 0), zb AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k, b) - 1 AS bin, 0.5::DOUBLE * (coalesce(lag(b) OVER (ORDER BY k, b), (SELECT lo FROM lim)) + b) AS mid FROM (SELECT v AS b, 0 AS k FROM zs UNION ALL SELECT hi, 1 FROM lim)), "
        + "zn AS (SELECT v, (SELECT count(*) FROM zs WHERE zs.v <= x.v) AS bin FROM x) " + end
    )


@query("zip_quantize", _zip_sql(64))
def zip_quantize(spark, d):
    return _binned(table(spark, d, "customer"), "c_acctbal", "least_squares", 64)


@query("quantizer_scale", _split_sql("customer", "c_acctbal", 16) + "SELECT row_number() OVER (ORDER BY v) - 1 AS i, round(v * 2.5::DOUBLE, 6) AS split FROM sp")
def quantizer_scale(spark, d):
    q = quantize.quantile(table(spark, d, "customer"), "c_acctbal", 16).times(2.5)
    return spark.createDataFrame(list(enumerate(q.splits)), "i long, split double").select("i", F.round("split", 6).alias("split"))


# ---------------------------------------------------------------- codecs

_FIXED = (
    "WITH n AS (SELECT sqrt(sum(c_acctbal * c_acctbal)) AS norm FROM customer), c AS (SELECT c_custkey AS key, c_acctbal AS v, norm, "
    "least(127, floor(abs(c_acctbal) / norm * 127) + (floor(c_custkey::BIGINT * 2654435761 / 65536)::BIGINT % 2))::INTEGER AS size FROM customer, n) "
)


@query("fixed_point_encode", _FIXED + "SELECT key, CASE WHEN v < 0 THEN size + 128 ELSE size END AS code FROM c")
def fixed_point_encode(spark, d):
    return codecs.fixed_point(_balances(spark, d), 8).select("key", "code")


@query("fixed_point_decode", _FIXED + "SELECT key, round(CASE WHEN v < 0 THEN -(size / 127.0::DOUBLE * norm) ELSE size / 127.0::DOUBLE * norm END, 4) + 0.0 AS decoded FROM c")
def fixed_point_decode(spark, d):
    return codecs.fixed_point(_balances(spark, d), 8).select("key", (F.round("decoded", 4) + 0.0).alias("decoded"))


_SIZES = {name: codecs.payload_bytes(name, 0) for name in ("none", "float", "fixed_point", "quantile")}


@query("codec_bytes", "WITH n AS (SELECT count(*) AS n FROM customer) SELECT 'none' AS codec, 12 * n AS bytes FROM n UNION ALL SELECT 'float', 8 * n FROM n UNION ALL SELECT 'fixed_point', 5 * n + 8 FROM n UNION ALL SELECT 'quantile', 5 * n + 8 * 255 + 32 FROM n")
def codec_bytes(spark, d):
    n = F.col("n")
    per = {k: codecs.payload_bytes(k, 1) - fixed for k, fixed in _SIZES.items()}
    counted = table(spark, d, "customer").agg(F.count("*").alias("n"))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("codec"), (n * per[k] + fixed).cast("long").alias("bytes")) for k, fixed in _SIZES.items()))).alias("r")).select("r.*")


def _restored(spark, d):
    return codecs.sketched(_balances(spark, d), bins=64)


def _sketch_sql(rows: int = 2, bins: int = 64) -> str:
    from ..functions.hashes import hashed_sql

    hashes = [f"h{i} AS (SELECT k.key, k.g, {i} AS row, ((x.raw % s.cols) + s.cols) % s.cols AS cell, k.bin FROM keyed k JOIN sizes s ON s.g = k.g JOIN ({hashed_sql(n, 'customer', 'c_custkey', 1 << 40).replace('AS hash', 'AS hash, x AS raw')}) x ON x.key = k.key)" for i, n in enumerate(("bj", "mix64")[:rows])]
    return (
        _split_sql("customer", "c_acctbal", bins)
        + ", z AS (SELECT count(*) AS zero FROM sp WHERE v < 0), q AS (SELECT count(*) + 1 AS bins FROM sp), "
        + "kb AS (SELECT c_custkey AS key, (SELECT count(*) FROM sp WHERE v <= c_acctbal) AS bin FROM customer), "
        + "sh AS (SELECT bins, zero, bins // 8 AS span FROM z, q), f AS (SELECT bins, span, CASE WHEN zero < span THEN zero WHEN zero % span < span // 2 THEN span + zero % span ELSE zero % span END AS first FROM sh), "
        + "keyed AS (SELECT key, bin, (SELECT count(*) FROM f, (SELECT unnest(range(0, 7)) AS i) e WHERE f.first + e.i * f.span <= kb.bin) AS g FROM kb), "
        + "sizes AS (SELECT g, ceil(count(*) * 0.3::DOUBLE)::BIGINT AS cols FROM keyed GROUP BY g), " + ", ".join(hashes) + ", "
        + "h AS (" + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(rows)) + "), "
        + "cells AS (SELECT g, row, cell, bin FROM (SELECT g, row, cell, bin, row_number() OVER (PARTITION BY g, row, cell ORDER BY abs(bin - zero), key) AS o FROM h, z) WHERE o = 1), "
        + "back AS (SELECT key, bin, row_number() OVER (PARTITION BY key ORDER BY abs(bin - zero) DESC, row) AS o FROM (SELECT h.key, h.row, cells.bin FROM h JOIN cells ON cells.g = h.g AND cells.row = h.row AND cells.cell = h.cell), z WHERE true) "
    )


@query("sketch_codec_roundtrip", _sketch_sql().replace("SELECT h.key, h.row, cells.bin FROM h JOIN", "SELECT h.key, h.row, cells.bin FROM h JOIN") + "SELECT keyed.key, keyed.g AS \"group\", keyed.bin, back.bin AS restored, round(eb.mid, 6) AS decoded FROM keyed JOIN back ON back.key = keyed.key AND back.o = 1 JOIN eb ON eb.bin = back.bin")
def sketch_codec_roundtrip(spark, d):
    return _restored(spark, d).select("key", F.col("group").cast("long").alias("group"), F.col("bin").cast("long").alias("bin"), F.col("restored").cast("long").alias("restored"), F.round("decoded", 6).alias("decoded"))


def _report_sql() -> str:
    """Values v and what comes back, d, of every codec; then distances."""
    back = {
        "none": "SELECT c_acctbal AS v, c_acctbal AS d FROM customer",
        "float": "SELECT c_acctbal AS v, c_acctbal::FLOAT::DOUBLE AS d FROM customer",
        "fixed_point": _FIXED + "SELECT v, sign(v) * size / 127.0::DOUBLE * norm AS d FROM c",
        "uniform": "WITH lim AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), sp AS MATERIALIZED (SELECT i, lo + (hi - lo) / 256 * i AS v FROM lim, (SELECT unnest(range(1, 256)) AS i)) SELECT c_acctbal AS v, lo + (hi - lo) / 256 * ((SELECT count(*) FROM sp WHERE v <= c_acctbal) + 0.5::DOUBLE) AS d FROM customer, lim",
        "quantile": _split_sql("customer", "c_acctbal", 256) + "SELECT v, mid AS d FROM bn JOIN eb ON eb.bin = bn.bin",
        "least_squares": _zip_sql(256, "SELECT v, mid AS d FROM zn JOIN zb ON zn.bin = zb.bin"),
        "sketch": _sketch_sql(bins=256) + "SELECT c_acctbal AS v, mid AS d FROM keyed JOIN back ON back.key = keyed.key AND back.o = 1 JOIN eb ON eb.bin = back.bin JOIN customer ON c_custkey = keyed.key",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS codec, count(*) AS n, round(sqrt(sum((v - d) * (v - d))), 4) AS euclidean, round(sum(v * d) / sqrt(sum(v * v)) / sqrt(sum(d * d)), 6) AS cosine, round(sqrt(sum((v - d) * (v - d)) / count(*)), 6) AS rmse FROM ({sql})" for k, sql in back.items())


@query("codec_report", _report_sql())
def codec_report(spark, d):
    r = codecs.report(_balances(spark, d))
    return r.select("codec", "n", F.round(F.sqrt("squared_euclidean"), 4).alias("euclidean"), F.round("cosine", 6).alias("cosine"), F.round("rmse", 6).alias("rmse"))


@query("minmax_never_farther", "SELECT count(*) AS n, 0::BIGINT AS farther FROM customer")
def minmax_never_farther(spark, d):
    zero = quantize.quantile(_balances(spark, d), "value", 64).zero
    rows = _restored(spark, d)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("restored") - zero) > F.abs(F.col("bin") - zero)).alias("farther"))


@query("minmax_build", _sketch_sql() + "SELECT g AS \"group\", row::BIGINT AS row, cell, bin FROM cells")
def minmax_build(spark, d):
    df = _balances(spark, d)
    q = quantize.quantile(df, "value", 64)
    pairs = df.withColumn("bin", q.bin(F.col("value")).cast("int")).withColumn("group", minmax.group_of(F.col("bin"), minmax.group_edges(q.zero, q.bins)))
    cells, _ = minmax.build(pairs.select("group", "key", "bin"), q.zero)
    return cells.select(F.col("group").cast("long").alias("group"), F.col("row").cast("long").alias("row"), "cell", F.col("bin").cast("long").alias("bin"))


@query("group_edges", _split_sql("customer", "c_acctbal", 64) + ", z AS (SELECT count(*) AS zero FROM sp WHERE v < 0), q AS (SELECT count(*) + 1 AS bins FROM sp), sh AS (SELECT bins, zero, bins // 8 AS span FROM z, q), f AS (SELECT bins, span, CASE WHEN zero < span THEN zero WHEN zero % span < span // 2 THEN span + zero % span ELSE zero % span END AS first FROM sh) SELECT i, CASE WHEN i = 7 THEN bins ELSE first + i * span END AS edge FROM f, (SELECT unnest(range(0, 8)) AS i)")
def group_edges(spark, d):
    q = quantize.quantile(table(spark, d, "customer"), "c_acctbal", 64)
    return spark.createDataFrame(list(enumerate(minmax.group_edges(q.zero, q.bins))), "i long, edge long")


@query("group_partition", _sketch_sql() + "SELECT g AS \"group\", count(*) AS n, min(bin) AS low, max(bin) AS high FROM keyed GROUP BY g")
def group_partition(spark, d):
    df = _balances(spark, d)
    q = quantize.quantile(df, "value", 64)
    rows = df.select(q.bin(F.col("value")).cast("long").alias("bin")).withColumn("group", minmax.group_of(F.col("bin"), minmax.group_edges(q.zero, q.bins)).cast("long"))
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.min("bin").alias("low"), F.max("bin").alias("high"))


@query("error_quantiles", _split_sql("customer", "c_acctbal", 64) + ", er AS (SELECT round(c_acctbal - mid, 6) AS e FROM customer JOIN eb ON eb.bin = (SELECT count(*) FROM sp WHERE sp.v <= c_acctbal)), o AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS r, count(*) OVER () AS n FROM er) SELECT i, (n * i) // 100 AS rank, e AS value FROM o JOIN (SELECT unnest(range(1, 100)) AS i) ON r = (n * i) // 100")
def error_quantiles(spark, d):
    coded = codecs.quantized(_balances(spark, d), "quantile", 64).select(F.round(F.col("value") - F.col("decoded"), 6).alias("e"))
    return quantiles.even_quantiles(coded, "e", 100)


@query("sparse_compressor_scaled", _sketch_sql() + "SELECT keyed.key, round(eb.mid * -0.5::DOUBLE, 6) AS value FROM keyed JOIN back ON back.key = keyed.key AND back.o = 1 JOIN eb ON eb.bin = back.bin")
def sparse_compressor_scaled(spark, d):
    return compressors.compress_sparse(_balances(spark, d), bins=64).times(-0.5).decompress().select("key", F.round("value", 6).alias("value"))


@query("dense_compressor", _split_sql("customer", "c_acctbal", 64) + "SELECT c_custkey AS key, round(mid * 2, 6) AS value FROM customer JOIN eb ON eb.bin = (SELECT count(*) FROM sp WHERE sp.v <= c_acctbal)")
def dense_compressor(spark, d):
    return compressors.compress_dense(_balances(spark, d), bins=64).times(2.0).decompress().select("key", F.round("value", 6).alias("value"))


@query("sparse_compressor", _sketch_sql() + "SELECT keyed.key, round(eb.mid, 6) AS value FROM keyed JOIN back ON back.key = keyed.key AND back.o = 1 JOIN eb ON eb.bin = back.bin")
def sparse_compressor(spark, d):
    return compressors.compress_sparse(_balances(spark, d), bins=64).decompress().select("key", F.round("value", 6).alias("value"))


@query("coded_sum", _sketch_sql() + "SELECT keyed.key, round(2 * mine.mid + eb.mid + c_acctbal, 6) AS value FROM keyed JOIN back ON back.key = keyed.key AND back.o = 1 JOIN eb ON eb.bin = back.bin JOIN eb mine ON mine.bin = keyed.bin JOIN customer ON c_custkey = keyed.key")
def coded_sum(spark, d):
    """A scaled dense vector, a sparse one and a plain one."""
    v = _balances(spark, d)
    total = compressors.added(compressors.compress_dense(v, bins=64).times(2.0), compressors.compress_sparse(v, bins=64), v)
    return total.select("key", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- order

@query("kth_smallest", "SELECT o_totalprice AS value FROM orders ORDER BY 1 LIMIT 1 OFFSET 99")
def kth_smallest(spark, d):
    return ranks.kth_smallest(table(spark, d, "orders"), "o_totalprice", 100)


@query("kth_largest", "SELECT o_totalprice AS value FROM orders ORDER BY 1 DESC LIMIT 1 OFFSET 99")
def kth_largest(spark, d):
    return ranks.kth_largest(table(spark, d, "orders"), "o_totalprice", 100)


@query("cosort", "SELECT o_custkey AS cust, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS pos, o_orderkey AS k, o_totalprice AS v FROM orders")
def cosort(spark, d):
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.collect_list("o_orderkey").alias("ks"), F.collect_list("o_totalprice").alias("vs"))
    return lists.select("cust", F.posexplode(order.cosorted(F.col("ks"), F.col("vs"))).alias("pos", "p")).select("cust", F.col("pos").cast("long").alias("pos"), "p.k", "p.v")


@query("kway_merge", "SELECT s_suppkey AS key, 0::BIGINT AS part FROM supplier UNION ALL SELECT p_partkey, 1 FROM part UNION ALL SELECT c_custkey, 2 FROM customer")
def kway_merge(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("key"), F.lit(i).cast("long").alias("part")) for i, (t, c) in enumerate((("supplier", "s_suppkey"), ("part", "p_partkey"), ("customer", "c_custkey")))]
    return order.merged(parts)


@query("unique_sorted", "SELECT l_orderkey AS key, count(DISTINCT l_quantity) AS n, min(l_quantity) AS first, max(l_quantity) AS last FROM lineitem GROUP BY 1")
def unique_sorted(spark, d):
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list("l_quantity").alias("a"))
    u = lists.select("key", order.unique_sorted(F.col("a")).alias("u"))
    return u.select("key", F.size("u").cast("long").alias("n"), F.element_at("u", 1).alias("first"), F.element_at("u", -1).alias("last"))


@query("argmax_first", "SELECT vec_id, max(x)::DOUBLE AS most, min(k) FILTER (x = m) AS place FROM (SELECT vec_id, x, k, max(x) OVER (PARTITION BY vec_id) AS m FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)) GROUP BY vec_id")
def argmax_first(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_max("embedding").cast("double").alias("most"), order.argmax_first(F.col("embedding")).cast("long").alias("place"))


@query("shuffled_orders")
def shuffled_orders(spark, d):
    return order.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("shuffled_places", "SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS place")
def shuffled_places(spark, d):
    """All places, each once: orders are numbered by key, and a bijection gives each its place."""
    numbered = glm.dealt(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1)
    n = numbered.count()
    return order.shuffled_places(numbered, "pos", n).select("place")
