"""The hot-group way must give the same rows as the plain window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import skew


@pytest.fixture(scope="module")
def skewed(spark):
    # one key holds a third of the rows, many rows share a time, some have none
    rows = [
        (i, "hot" if i % 3 == 0 else f"k{i % 17}", None if i % 11 == 0 else (i * 7) % 40, i % 13)
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "row_id long, k string, t long, v long").repartition(5)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("keys", [["k"], []])
def test_positions(skewed, keys):
    plain = skew.row_positions(skewed, keys, ["t", "row_id"], "p")
    sliced = skew.row_positions(skewed, keys, ["t", "row_id"], "p", limit=50)
    assert rows(plain) == rows(sliced)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [2, 30])
def test_trailing_frame(skewed, keys, limit):
    out = {
        "s": lambda w: F.sum("v").over(w),
        "n": lambda w: F.count(F.lit(1)).over(w),
        "ids": lambda w: F.collect_list("row_id").over(w),
    }
    plain = skew.trailing_frame(skewed, keys, ["t", "row_id"], 4, out)
    sliced = skew.trailing_frame(skewed, keys, ["t", "row_id"], 4, out, limit=limit)
    assert rows(plain) == rows(sliced)


def test_running_total(skewed):
    plain = skew.running_totals(skewed, ["-t", "-row_id"], {"total": "v", "other": "row_id"})
    sliced = skew.running_totals(skewed, ["-t", "-row_id"], {"total": "v", "other": "row_id"}, limit=40)
    assert rows(plain) == rows(sliced)


def test_group_counts_with_null_keys(skewed):
    out = {"n": F.count("v"), "m": F.max("row_id")}
    plain = skew.group_counts(skewed, ["t"], out)
    sliced = skew.group_counts(skewed, ["t"], out, limit=20)
    assert rows(plain) == rows(sliced)


def test_lookup_beyond_broadcast(spark, skewed):
    dim = spark.createDataFrame([("hot", 1.0), ("k1", 2.0)], "k string, w double")
    small = skew.lookup(skewed, dim, ["k"])
    big = skew.lookup(skewed, dim, ["k"], limit=50, row_bytes=64, budget=64)
    assert rows(small) == rows(big)
    assert small.filter("k = 'hot'").agg(F.min("w")).first()[0] == 1.0


@pytest.mark.parametrize("ties", [False, True])
def test_exact_quantile_in_passes(spark, ties):
    values = [float(i % 3) if ties else float((i * 7919) % 5003) / 7 for i in range(5003)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = skew.exact_quantile(df, "x", q, limit=60)
        assert got == pytest.approx(np.percentile(values, q * 100), abs=1e-12)
