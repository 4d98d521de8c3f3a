"""Compare a query with its SQL on the same files."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame: pd.DataFrame):
    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v) for v in r))
    return sorted(out)


def same(spark, con, query, sql, sf_dir):
    mine, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
