"""Comparison of a Spark result with DuckDB SQL over the same tables."""

import glob
import os


def run_sql(sql, sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con.sql(sql).df()


def same_rows(df, sql, sf):
    a, b = df.toPandas(), run_sql(sql, sf)
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        assert (a[c] == b[c]).all(), c
