"""Queries over sources, splits and cursors, and windows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glm
from ..sources import text
from ..sources.shared import Scratch, cut
from ..streaming.windows import window_sketches
from .registry import query, table


@query("parse_libsvm_roundtrip", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0 END AS label, k AS key, CASE k WHEN 1 THEN o_custkey::DOUBLE ELSE round(o_totalprice, 2) END AS value FROM orders, (SELECT unnest([1, 7]) AS k)")
def parse_libsvm_roundtrip(spark, d):
    line = F.concat_ws(" ", F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"), F.concat(F.lit("1:"), F.col("o_custkey")), F.concat(F.lit("7:"), F.round("o_totalprice", 2)))
    lines = table(spark, d, "orders").select("o_orderkey", line.alias("value"))
    # The parser works on a column; the id travels in front of the line and is cut off again.
    rows = text.parse(lines.select(F.concat_ws(" ", F.regexp_extract("value", r"^\S+", 0), F.concat(F.lit("0:"), F.col("o_orderkey")), F.regexp_extract("value", r"^\S+ (.*)$", 1)).alias("value")), "libsvm")
    return rows.select(F.col("val")[0].cast("long").alias("id"), "label", F.explode(F.arrays_zip(F.slice("idx", 2, 2).alias("i"), F.slice("val", 2, 2).alias("v"))).alias("p")).select("id", "label", F.col("p.i").alias("key"), F.col("p.v").alias("value"))


@query("text_source_load", "SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0 END AS label, k AS key, count(*) AS n, round(sum(CASE k WHEN 1 THEN o_custkey::DOUBLE ELSE round(o_totalprice, 2) END), 1) AS total FROM orders, (SELECT unnest([1, 7]) AS k) GROUP BY 1, 2")
def text_source_load(spark, d):
    """Lines written as text files, loaded in partitions of their own number."""
    line = F.concat_ws(" ", F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"), F.concat(F.lit("1:"), F.col("o_custkey")), F.concat(F.lit("7:"), F.round("o_totalprice", 2)))
    with Scratch(spark) as scratch:
        table(spark, d, "orders").select(line).write.text(f"{scratch.folder}/lines")
        rows = text.load(spark, f"{scratch.folder}/lines", "libsvm", 6)
        found = rows.select("label", F.explode(F.arrays_zip("idx", "val")).alias("p")).groupBy("label", F.col("p.idx").alias("key")).agg(F.count("*").alias("n"), F.round(F.sum("p.val"), 1).alias("total"))
        return cut(found)  # the lines go


@query("parse_csv_dense", "SELECT c_custkey AS id, CASE WHEN abs(c_nationkey - 1) > 1e-8 THEN -1.0::DOUBLE ELSE 1.0 END AS label, c_acctbal AS value FROM customer")
def parse_csv_dense(spark, d):
    lines = table(spark, d, "customer").select(F.concat_ws(",", "c_nationkey", "c_custkey", "c_acctbal").alias("value"))
    return text.parse(lines, "csv").select(F.col("features")[0].cast("long").alias("id"), "label", F.col("features")[1].alias("value"))


@query("parse_dummy_onehot", "SELECT c_custkey::INTEGER AS id, c_nationkey AS key, 1.0::DOUBLE AS value, -1.0::DOUBLE AS label FROM customer")
def parse_dummy_onehot(spark, d):
    lines = table(spark, d, "customer").select(F.concat_ws(",", F.lit("0"), F.col("c_custkey"), F.col("c_nationkey")).alias("value"))
    return text.parse(lines, "dummy").select(F.col("idx")[0].alias("id"), F.col("idx")[1].alias("key"), F.col("val")[1].alias("value"), "label")


@query("label_sign", "SELECT quality, CASE WHEN abs(quality - 1) > 1e-8 THEN -1.0::DOUBLE ELSE quality::DOUBLE END AS label, count(*) AS n FROM labels GROUP BY 1, 2")
def label_sign(spark, d):
    return table(spark, d, "labels").select("quality", text.signed_label(F.col("quality").cast("double")).alias("label")).groupBy("quality", "label").agg(F.count("*").alias("n"))


@query("hash_split_counts", "SELECT count(*) FILTER (o_orderkey * 7919 % 1000 >= 250) AS train, count(*) FILTER (o_orderkey * 7919 % 1000 < 250) AS valid FROM orders")
def hash_split_counts(spark, d):
    train, valid = glm.split(table(spark, d, "orders"), "o_orderkey", 0.25)
    return train.agg(F.count("*").alias("train")).join(F.broadcast(valid.agg(F.count("*").alias("valid"))))  # a row each


_CURSOR = "WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS worker, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderkey % 4) AS size FROM orders) "


@query("minibatch_cursor", _CURSOR + "SELECT worker, count(*) AS n, sum(id)::BIGINT AS ids FROM r WHERE ((pos - 13 * floor(size * 0.1::DOUBLE)::BIGINT) % size + size) % size < floor(size * 0.1::DOUBLE) GROUP BY worker")
def minibatch_cursor(spark, d):
    rows = glm.dealt(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 4)
    return glm.batch(rows, 13, 0.1).groupBy(F.col("worker").cast("long").alias("worker")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("narrow_bins", "SELECT l_linenumber AS id, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS bins FROM lineitem GROUP BY 1")
def narrow_bins(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("int").alias("bin"))
    return text.wide_bins(text.narrow_bins(rows, 256), 256).groupBy("id").agg(F.count("*").alias("n"), F.sum("bin").alias("bins"))


@query("event_window_summary", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(value) AS n, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1")
def event_window_summary(spark, d):
    return window_sketches(table(spark, d, "events")).drop("sketch")
