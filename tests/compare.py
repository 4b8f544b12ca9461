"""Row-by-row comparison of a query with its DuckDB SQL."""

import os

import duckdb


def expected(sql, sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        table = name.removesuffix(".parquet")
        con.sql(f"create view {table} as select * from '{sf_dir}/{name}'")
    return con.sql(sql).df()


def assert_same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (frame[columns].astype(str).sort_values(columns).reset_index(drop=True) for frame in (got, want))
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head()
