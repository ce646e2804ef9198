"""Rows of an operator's query and of its DuckDB SQL, in one order."""

from __future__ import annotations

import glob
import os

import duckdb


def compared(frame, sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    other = con.execute(sql).df()
    columns = sorted(frame.columns)
    assert columns == sorted(other.columns)

    def rows(df):
        return sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=str)

    return rows(frame.toPandas()), rows(other)
