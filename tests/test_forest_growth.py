"""Forests on whole tables: bags of all rows, growth and scoring where the table or the trees are large."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import forest, forest_growth, models
from flowloom.plans.retrain import retrain_once
from flowloom.settings import Settings

ROWS = 40_000  # a bag was at most 32,768 of them


def root_values(ch):
    return np.array([float(t["value"][0]) for t in ch.pipeline.trees])


def whole_bags(values, rows):
    """Shares of a bag of so many rows are whole numbers of rows."""
    counts = values * rows
    return len(values) > 0 and bool((np.abs(counts - counts.round()) < 0.01).all())


def table(spark, rows):
    h = F.xxhash64("id")
    return spark.range(rows).select(
        F.col("id").alias("row_id"), F.pmod(h, F.lit(1000)).cast("double").alias("a"),
        F.pmod(h, F.lit(7)).cast("double").alias("b"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("is_attack"))


def test_forest_channel_bags_hold_all_rows(spark):
    ch = models.fit_forest(table(spark, ROWS), ["a", "b"], Settings(forest_trees=6, forest_depth=2))
    assert whole_bags(root_values(ch), ROWS)


def test_bags_grow_beyond_the_former_bound_of_rows(spark):
    """Of more than 200,000 rows only about that many were looked at."""
    ch = models.fit_forest(table(spark, 230_000), ["a", "b"], Settings(forest_trees=4, forest_depth=1))
    assert whole_bags(root_values(ch), 230_000)


def test_header_channel_bags_hold_all_rows(spark):
    df = table(spark, ROWS).withColumn("header_bytes", F.unhex(F.repeat(F.substring(F.sha2(F.col("row_id").cast("string"), 256), 1, 64), 30)))
    ch = models.fit_header(df, Settings(forest_trees=3, header_depth=1))
    assert whole_bags(root_values(ch), ROWS)


def test_retraining_bags_hold_all_rows(spark, tmp_path):
    df = table(spark, 50_000).withColumn("Timestamp", F.timestamp_seconds("row_id"))
    cfg = Settings(min_retrain_rows=100, forest_trees=3, forest_depth=2, isolation_trees=5)
    done = retrain_once(df, str(tmp_path / "r"), ["a", "b"], cfg, deep=False).first()
    assert done.result == "ok" and "random_forest=accepted" in done.decisions
    path = next((tmp_path / "r" / "models" / "random_forest").iterdir())
    assert whole_bags(root_values(models.Channel.load(spark, str(path))), 40_000)


def odd_rows(spark, rows=6000):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(rows, 5)).round(2)
    x[:, 1] = rng.integers(0, 2, rows)  # splits make it constant further down
    x[:, 2] = np.where(x[:, 2] > 0, 1e12, -0.0)
    x[:, 3] = 4.0
    x[:50, 0] = -1e12
    y = x[:, 0] * x[:, 4] + x[:, 1] + rng.normal(size=rows) > 0
    data = [(i, [float(v) for v in r], bool(l)) for i, (r, l) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(data, "id long, x array<double>, y boolean").repartition(5)


@pytest.fixture
def small_limits(monkeypatch):
    monkeypatch.setattr(forest, "GATHERED", 10)
    monkeypatch.setattr(forest_growth, "HOME", 3500)
    monkeypatch.setattr(forest, "CHUNK", 500)
    monkeypatch.setattr(forest_growth, "WAVE", 100_000)
    monkeypatch.setattr(forest, "TOGETHER", 100)


def chunks_of(df):
    return forest.materialize(forest._labelled(df, F.col("x"), F.col("y")).mapInArrow(forest._chunks, forest.CHUNKS))


def test_borders_are_exact_quantiles(spark):
    x, _, df = odd_rows(spark)
    expected = forest.quantile_cuts(x)
    got = forest_growth.exact_cuts(chunks_of(df), len(x), 5)
    assert len(got) == 5 and all(list(a) == list(b) for a, b in zip(got, expected))
    one = forest_growth.exact_cuts(chunks_of(df.limit(1)), 1, 5)
    assert [len(c) for c in one] == [1] * 5


@pytest.mark.parametrize("depth", [3, 24])
def test_nodes_of_large_tables_hold_the_shares_of_all_rows(spark, small_limits, depth):
    """Every row of every chunk is sent down the trees with its weight; each node's value is the share found there."""
    x, y, df = odd_rows(spark)
    chunks = chunks_of(df)
    model = forest.HistogramForest.of(forest_growth.grown(chunks, len(x), 5, 4, depth, 2, 42))
    assert model.count() == 4
    for number, t in enumerate(model.trees):
        total, hits, seen = np.zeros(len(t["value"])), np.zeros(len(t["value"])), 0
        for r in chunks.collect():
            rows = np.frombuffer(r["x"]).reshape(-1, 5)
            w = forest_growth._weights(42, number, r["part"], r["chunk"], r["rows"]).astype(float)
            label = np.frombuffer(r["y"], np.uint8)
            seen += len(rows)
            node, live = np.zeros(len(rows), int), np.ones(len(rows), bool)
            for level in range(depth + 1):
                np.add.at(total, node[live], w[live])
                np.add.at(hits, node[live], (w * label)[live])
                f = t["feature"][node]
                live &= f >= 0
                low = rows[np.arange(len(rows)), np.maximum(f, 0)] <= t["cut"][node]
                node = np.where(live, np.where(low, t["left"][node], t["right"][node]), node)
            assert not live.any()
        assert seen == len(x) and abs(total[0] - seen) < 6 * seen ** 0.5
        assert (total > 0).all() and (t["value"] == (hits / total).astype(np.float32)).all()
        leaf = t["feature"] < 0
        reached = np.sort(np.concatenate([[0], t["left"][~leaf], t["right"][~leaf]]))
        assert list(reached) == list(range(len(leaf)))  # every node has one parent
        if depth == 24:
            assert len(leaf) > 500 and leaf.sum() == (~leaf).sum() + 1


def test_large_tables_and_stored_trees_score_alike(spark, small_limits, monkeypatch, tmp_path):
    x, y, df = odd_rows(spark)
    df = df.unionByName(spark.createDataFrame([(9000, None, None), (9001, [float("nan")] * 5, None)], df.schema))
    model = forest.fit(df, F.col("x"), F.col("y"), 8, 24)
    expected = {r["id"]: r["s"] for r in model.score(df, F.col("x"), "s").collect()}
    model.save(spark, str(tmp_path / "f"))
    monkeypatch.setattr(forest, "SHARED", 1000)
    stored = forest.HistogramForest.load(spark, str(tmp_path / "f"))
    assert stored.trees is None and stored.count() == 8
    stored.save(spark, str(tmp_path / "g"))
    again = forest.HistogramForest.load(spark, str(tmp_path / "g"))
    scored = again.score(df.withColumn("s", F.lit("former")), F.col("x"), "s")  # an older column of that name is replaced
    assert scored.columns == ["id", "x", "y", "s"]
    got = {r["id"]: r["s"] for r in scored.collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-12 for i in got)
    assert got[9000] == 0.0 and len(got) == 6002
    monkeypatch.setattr(forest, "GATHERED", 10**9)
    plain = {r["id"]: r["s"] for r in forest.fit(df, F.col("x"), F.col("y"), 8, 24).score(df, F.col("x"), "s").collect()}
    right = [np.mean([(s[i] >= 0.5) == bool(y[i]) for i in range(len(y))]) for s in (got, plain)]
    assert right[0] > 0.8 and abs(right[0] - right[1]) < 0.03


def test_groups_of_nodes_grow_the_whole_tree(monkeypatch):
    """A level of many rows is taken in groups of nodes; the tree still knows its rows."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 32, (5000, 4)).astype(np.uint8)
    y = rng.random(5000).round()
    monkeypatch.setattr(forest, "TOGETHER", 60)
    w = np.ones(len(x))
    t = forest.grow(x, w, y, np.zeros(len(x), np.int64), 1, forest.borders([np.arange(31.0)] * 4), rng, 99, 4)
    node = np.zeros(len(x), int)
    for _ in range(100):
        f = t["feature"][node]
        low = x[np.arange(len(x)), np.maximum(f, 0)] <= t["cut"][node]
        node = np.where(f >= 0, np.where(low, t["left"][node], t["right"][node]), node)
    same = {}
    for row, label, value in zip(map(tuple, x), y, t["value"][node]):
        same.setdefault(row, []).append((label, value))
    assert all(abs(np.mean([a for a, _ in v]) - v[0][1]) < 1e-6 for v in same.values())
