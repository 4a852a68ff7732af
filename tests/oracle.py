"""Compare a registered query with its SQL twin, both on the same parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def rows_of_spark(df):
    columns = sorted(df.columns)
    rows = [tuple(normal(r[c]) for c in columns) for r in df.collect()]
    return columns, sorted(rows, key=key)


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    rows = [tuple(normal(r[i]) for i in at) for r in cursor.fetchall()]
    return columns, sorted(rows, key=key)


def difference(df, con, sql) -> str | None:
    """None when both give the same columns and rows, else what differs first."""
    spark_columns, spark_rows = rows_of_spark(df)
    sql_columns, sql_rows = rows_of_sql(con, sql)
    if spark_columns != sql_columns:
        return f"columns {spark_columns} vs {sql_columns}"
    if len(spark_rows) != len(sql_rows):
        only_spark = sorted(set(spark_rows) - set(sql_rows), key=key)[:2]
        only_sql = sorted(set(sql_rows) - set(spark_rows), key=key)[:2]
        return f"{len(spark_rows)} rows vs {len(sql_rows)}; only spark {only_spark}; only sql {only_sql}"
    for a, b in zip(spark_rows, sql_rows):
        if a != b:
            return f"{spark_columns}: {a} vs {b}"
    return None
