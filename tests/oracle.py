"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).df()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT:
            return "null"
        if isinstance(x, float):
            return "null" if x != x else f"{x:.6f}"
        return repr(list(x)) if hasattr(x, "__iter__") and not isinstance(x, (str, bytes, dict)) else str(x)

    # Integers with nulls come as floats from Spark and as Int64 from DuckDB.
    df = df.astype({c: "float64" for c in df.columns if str(df[c].dtype) in ("Int64", "Int32")})
    df = df[sorted(df.columns)].astype(object).map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def check(spark, queries, oracles, name: str, sf_dir: str) -> None:
    got, want = plain(queries[name](spark, sf_dir).toPandas()), plain(duck(sf_dir, oracles[name]))
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(got, want)
