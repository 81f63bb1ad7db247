"""Runs a query and its SQL counterpart and compares the rows."""

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    return v


def rows_of(frame):
    columns = sorted(frame.columns)
    data = [tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return columns, sorted(data, key=repr)


def compare(spark_df, con, sql):
    """None when equal, else a short description of the first difference."""
    names, got = rows_of(spark_df.toPandas())
    expected_names, expected = rows_of(con.execute(sql).df())
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b and repr(a) != repr(b):
            return f"{names}: {a} != {b}"
    return None


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def forbidden_joins(spark_df):
    """Join kinds that must not appear in a query's plan."""
    plan = spark_df._jdf.queryExecution().executedPlan().toString()
    return [f for f in FORBIDDEN if f in plan]
