"""All registered queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "sketch_codec_roundtrip"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def merging_sql(bins: int, rounds: int) -> str:
    """CTEs p1 .. p<rounds> of the least-squares quantizer after p0(worker, i, n, s, q, low): neighbours are paired, and all but the
    worst pairs merged, until at most ``bins`` intervals are left; rounds after that change nothing."""
    sql = ""
    for k in range(rounds):
        sql += (
            f", c{k} AS MATERIALIZED (SELECT *, i // 2 AS pair, count(*) OVER (PARTITION BY worker) AS len FROM p{k}), "
            f"e{k} AS MATERIALIZED (SELECT worker, pair, count(*) AS m, max(len) AS len, sum(q) - sum(s) * sum(s) / sum(n) AS err FROM c{k} GROUP BY worker, pair), "
            f"r{k} AS MATERIALIZED (SELECT worker, pair, len <= {bins} OR m = 1 OR row_number() OVER (PARTITION BY worker ORDER BY m DESC, err DESC, pair) <= greatest(0, least({bins // 2} - len % 2, len // 2 - 1)) AS apart FROM e{k}), "
            f"u{k} AS MATERIALIZED (SELECT worker, i, n, s, q, low FROM c{k} JOIN r{k} USING (worker, pair) WHERE apart UNION ALL SELECT worker, min(i), sum(n), sum(s), sum(q), min(low) FROM c{k} JOIN r{k} USING (worker, pair) WHERE NOT apart GROUP BY worker, pair), "
            f"p{k + 1} AS MATERIALIZED (SELECT worker, row_number() OVER (PARTITION BY worker ORDER BY i) - 1 AS i, n, s, q, low FROM u{k})"
        )
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import data_queries, integer_queries, model_queries, vector_queries  # noqa: E402, F401
