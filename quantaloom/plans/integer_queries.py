"""Queries over integers: hashes, bits, delta codes and Huffman codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, hashes
from ..operators import delta, huffman
from .registry import query, table

SIZE = 1009


def _hash_query(name):
    @query(f"hash_{name}", hashes.hashed_sql(name, "part", "p_partkey", SIZE))
    def run(spark, d):
        return table(spark, d, "part").select(F.col("p_partkey").alias("key"), hashes.hashed(name, F.col("p_partkey"), SIZE).alias("hash"))

    return run


for _name in hashes.ROUNDS:
    _hash_query(_name)


def _bkdr_sql(seed: int) -> str:
    wrap = "((((a * {s} + c) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)".format(s=seed)
    return (
        "WITH RECURSIVE r(key, rest, a) AS (SELECT p_partkey, reverse(p_partkey::VARCHAR), 0::BIGINT FROM part UNION ALL "
        f"SELECT key, substr(rest, 2), (SELECT {wrap} FROM (SELECT substr(rest, 1, 1)::BIGINT AS c)) FROM r WHERE rest <> '') SELECT key, (a % {SIZE} + {SIZE}) % {SIZE} AS hash FROM r WHERE rest = ''"
    )


def _bkdr_query(seed):
    @query(f"hash_bkdr{seed}", _bkdr_sql(seed))
    def run(spark, d):
        return table(spark, d, "part").select(F.col("p_partkey").alias("key"), hashes.digit_hashed(seed, F.col("p_partkey"), SIZE).alias("hash"))

    return run


for _seed in hashes.BKDR_SEEDS:
    _bkdr_query(_seed)


@query("bits_to_string", "SELECT p_partkey AS key, right(repeat('0', 24) || bin(p_partkey), 24) AS bits, p_partkey AS back FROM part")
def bits_to_string(spark, d):
    b = bits.bits_of(F.col("p_partkey"), 24)
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), b.alias("bits"), bits.number_of(b).alias("back"))


@query("log2_floor", "SELECT p_partkey AS key, length(bin(p_partkey)) - 1 AS log2 FROM part WHERE p_partkey > 0")
def log2_floor(spark, d):
    return table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("key"), bits.log2_floor(F.col("p_partkey")).cast("long").alias("log2"))


@query("pow2_flag", "SELECT p_partkey AS key, bit_count(p_partkey) = 1 AND p_partkey BETWEEN 1 AND 32768 AS power FROM part")
def pow2_flag(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), bits.is_power_of_two(F.col("p_partkey")).alias("power"))


#: Keys per group of a delta code.
GROUP = 4096


def _keys(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct().withColumn("group", F.expr(f"key div {GROUP}"))


_GAPS = f"WITH k AS (SELECT DISTINCT l_orderkey AS key, l_orderkey // {GROUP} AS g FROM lineitem), gp AS (SELECT key, g, key - coalesce(lag(key) OVER (PARTITION BY g ORDER BY key), 0) AS gap FROM k), b AS (SELECT key, g, gap, CASE WHEN gap = 0 THEN 1 ELSE length(bin(gap)) END AS bits FROM gp) "


@query("delta_gaps", _GAPS + "SELECT g AS \"group\", key, gap, bits FROM b")
def delta_gaps(spark, d):
    return delta.gaps(_keys(spark, d)).select("group", "key", "gap", F.col("bits").cast("long").alias("bits"))


@query("delta_bit_histogram", _GAPS + "SELECT bits, count(*) AS n FROM b GROUP BY bits")
def delta_bit_histogram(spark, d):
    return delta.gaps(_keys(spark, d)).groupBy(F.col("bits").cast("long").alias("bits")).agg(F.count("*").alias("n"))


_COST = _GAPS + ", m AS (SELECT unnest([2, 4, 8, 16]) AS m), u AS (SELECT g, m, avg((bits // (32 // m) + 1)::DOUBLE) AS used FROM b, m GROUP BY g, m), c AS (SELECT g, m, 'fixed' AS flag, used * (32 // m) + log2(m) AS cost FROM u UNION ALL SELECT g, m, 'unary', used * (32 // m + 1) + 1 FROM u) "


@query("delta_adaptive_cost", _COST + "SELECT g AS \"group\", m::BIGINT AS intervals, flag, round(cost, 6) AS cost FROM c")
def delta_adaptive_cost(spark, d):
    return delta.adaptive_cost(delta.gaps(_keys(spark, d))).select("group", F.col("intervals").cast("long").alias("intervals"), "flag", F.round("cost", 6).alias("cost"))


_CHOSEN = _COST + ", p AS (SELECT g, m, flag FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cost, m, flag) AS o FROM c WHERE cost < 32) WHERE o = 1), z AS (SELECT b.g, b.gap, b.bits, coalesce(p.m, 1) AS m, coalesce(p.flag, 'none') AS flag FROM b LEFT JOIN p ON p.g = b.g), w AS (SELECT g, m, flag, ceil(bits / (32.0::DOUBLE / m))::BIGINT AS n FROM z) "


@query("delta_adaptive_size", _CHOSEN + "SELECT g AS \"group\", max(m)::BIGINT AS intervals, max(flag) AS flag, count(*) AS n, sum(n * (32 // m) + CASE flag WHEN 'fixed' THEN log2(m)::BIGINT WHEN 'unary' THEN n ELSE 0 END)::BIGINT AS bits FROM w GROUP BY g")
def delta_adaptive_size(spark, d):
    return delta.encode(delta.gaps(_keys(spark, d))).select("group", F.col("intervals").cast("long").alias("intervals"), "flag", "n", "bits")


@query("delta_roundtrip", f"SELECT DISTINCT l_orderkey // {GROUP} AS \"group\", l_orderkey AS key FROM lineitem")
def delta_roundtrip(spark, d):
    return delta.decode(delta.encode(delta.gaps(_keys(spark, d)))).select("group", "key")


@query("delta_binary_size", _GAPS + "SELECT g AS \"group\", count(*) AS n, sum(2 + 8 * CASE WHEN gap < 256 THEN 1 WHEN gap < 65536 THEN 2 ELSE 4 END)::BIGINT AS total_bits FROM b GROUP BY g")
def delta_binary_size(spark, d):
    return delta.byte_sizes(delta.gaps(_keys(spark, d)))


_BINARY = _GAPS + ", c AS (SELECT g, key, gap, CASE WHEN gap < 256 THEN 1 WHEN gap < 65536 THEN 2 ELSE 4 END AS bytes FROM b) "


@query("delta_binary_payload", _BINARY + "SELECT g AS \"group\", count(*) AS n, sum(bytes)::BIGINT + (2 * count(*) + 7) // 8 AS bytes, md5(string_agg(lpad(lower(to_hex(gap)), 2 * bytes, '0'), '' ORDER BY key)) AS gaps FROM c GROUP BY g")
def delta_binary_payload(spark, d):
    coded = delta.encode_bytes(delta.gaps(_keys(spark, d)))
    gaps = F.lower(F.hex(F.expr("substring(payload, (2 * n + 7) div 8 + 1)")))
    return coded.select("group", "n", F.length("payload").cast("long").alias("bytes"), F.md5(gaps).alias("gaps"))


@query("delta_binary_roundtrip", f"SELECT DISTINCT l_orderkey // {GROUP} AS \"group\", l_orderkey AS key FROM lineitem")
def delta_binary_roundtrip(spark, d):
    return delta.decode_bytes(delta.encode_bytes(delta.gaps(_keys(spark, d)))).select("group", "key")


@query("delta_decode", f"SELECT DISTINCT l_orderkey // {GROUP} AS \"group\", l_orderkey AS key FROM lineitem")
def delta_decode(spark, d):
    g = delta.gaps(_keys(spark, d)).withColumnRenamed("key", "pos")
    return delta.undo(g).select("group", "key")


# ---------------------------------------------------------------- keys beyond 32 bits

#: Gaps of some 20 bits, and one of 34 at every 512th order.
_LONG_KEYS = f"SELECT DISTINCT l_orderkey * 1048583 + (l_orderkey // 512) * 17179869184 + l_linenumber AS key, l_orderkey // {GROUP} AS g FROM lineitem"


def _long_keys(spark, d):
    key = F.col("l_orderkey") * 1048583 + F.expr("l_orderkey div 512") * 17179869184 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(key.alias("key"), F.expr(f"l_orderkey div {GROUP}").alias("group")).distinct()


@query("delta_long_gaps", f"WITH k AS ({_LONG_KEYS}), s AS (SELECT key, g, key - lag(key) OVER (PARTITION BY g ORDER BY key) AS step FROM k), b AS (SELECT key, g, step, step IS NULL OR step >= 4294967296 AS begins FROM s) SELECT g AS \"group\", key, CASE WHEN begins THEN key % 4294967296 ELSE step END AS gap, last_value(CASE WHEN begins THEN key - key % 4294967296 END IGNORE NULLS) OVER (PARTITION BY g ORDER BY key) AS base FROM b")
def delta_long_gaps(spark, d):
    return delta.gaps(_long_keys(spark, d)).select("group", "key", "gap", "base")


@query("delta_long_roundtrip", f"SELECT g AS \"group\", key, row_number() OVER (PARTITION BY g ORDER BY key) - 1 AS pos FROM ({_LONG_KEYS})")
def delta_long_roundtrip(spark, d):
    return delta.decode(delta.encode(delta.gaps(_long_keys(spark, d))))


@query("delta_long_binary_roundtrip", f"SELECT g AS \"group\", key, row_number() OVER (PARTITION BY g ORDER BY key) - 1 AS pos FROM ({_LONG_KEYS})")
def delta_long_binary_roundtrip(spark, d):
    return delta.decode_bytes(delta.encode_bytes(delta.gaps(_long_keys(spark, d))))


@query("code_offsets", _GAPS + "SELECT g AS \"group\", key, (sum(bits) OVER (PARTITION BY g ORDER BY key) - bits)::BIGINT AS begin FROM b")
def code_offsets(spark, d):
    from ..operators.quantiles import running_sum

    return running_sum(delta.gaps(_keys(spark, d)), "key", "bits", ["group"]).select("group", "key", (F.col("running") - F.col("bits")).cast("long").alias("begin"))


def _quantities(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("q"))


@query("huffman_freq", "SELECT l_quantity::BIGINT AS value, count(*) AS n FROM lineitem GROUP BY 1")
def huffman_freq(spark, d):
    return huffman.counts(_quantities(spark, d), "q")


@query("huffman_packed_roundtrip", "SELECT l_orderkey // 512 AS \"group\", l_quantity::BIGINT AS value, count(*) AS n FROM lineitem GROUP BY 1, 2")
def huffman_packed_roundtrip(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr("l_orderkey div 512").alias("group"), "l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    code = huffman.fit(rows, "q")
    back = huffman.unpack(huffman.pack(rows, "group", "l_orderkey", "q", code), "group", code)
    return back.groupBy("group", "value").agg(F.count("*").alias("n"))


@query("huffman_roundtrip", "SELECT l_quantity::BIGINT AS q, count(*) AS n, count(*) AS same FROM lineitem GROUP BY 1")
def huffman_roundtrip(spark, d):
    rows = _quantities(spark, d)
    code = huffman.fit(rows, "q")
    back = huffman.decode(huffman.encode(rows, "q", code), code)
    return back.groupBy("q").agg(F.count("*").alias("n"), F.count_if(F.col("q") == F.col("decoded")).alias("same"))


#: The two least counts are merged until one is left; every merge adds a bit to all below it.
_HUFFMAN = (
    "WITH RECURSIVE f AS (SELECT l_quantity::BIGINT AS v, count(*) AS n FROM lineitem GROUP BY 1), r(l, bits) AS (SELECT list_sort(list(n)), 0::BIGINT FROM f "
    "UNION ALL SELECT list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM r WHERE len(l) > 1) "
    "SELECT max(bits)::BIGINT AS total_bits, (SELECT sum(n)::BIGINT FROM f) AS n FROM r"
)


@query("huffman_total_bits", _HUFFMAN)
def huffman_total_bits(spark, d):
    rows = _quantities(spark, d)
    return huffman.total_bits(rows, "q", huffman.fit(rows, "q"))


def _parts(spark, d):
    return table(spark, d, "lineitem").select(F.expr("l_orderkey div 512").alias("group"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("q"))


@query("huffman_table_total_bits", _HUFFMAN.replace("l_quantity::BIGINT", "l_partkey"))
def huffman_table_total_bits(spark, d):
    """Codes that stay a table: the driver holds lengths by count alone."""
    rows = _parts(spark, d)
    return huffman.total_bits(rows, "q", huffman.fit(rows, "q", most=100))


@query("huffman_table_roundtrip", "SELECT l_orderkey // 512 AS \"group\", l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1, 2")
def huffman_table_roundtrip(spark, d):
    rows = _parts(spark, d)
    code = huffman.fit(rows, "q", most=100)
    back = huffman.unpack(huffman.pack(rows, "group", "l_orderkey", "q", code), "group", code)
    return back.groupBy("group", "value").agg(F.count("*").alias("n"))
