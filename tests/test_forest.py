"""Histogram forest: splits against a plain search, properties, saving, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from flowloom.operators import forest, models
from flowloom.settings import Settings


def plain_split(x, y):
    """The purest first split over all features and values: squared class counts over sizes."""
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            score = 0.0
            for side in (y[x[:, f] <= cut], y[x[:, f] > cut]):
                score += (side.sum() ** 2 + (len(side) - side.sum()) ** 2) / len(side)
            if best is None or score > best[0] + 1e-9:
                best = (score, f, cut)
    return best


def test_first_split_is_the_purest():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.integers(0, 9, (60, 3)).astype(float)
        y = (rng.random(60) < 0.2 + 0.6 * (x[:, 1] > 4)).astype(float)
        cuts = forest.quantile_cuts(x)
        slot = np.zeros(60, np.int64)
        bins = forest.binned(x, cuts)
        score, f, place = forest._best_splits(
            bins, np.ones(60), y, slot, np.array([60.0]), np.array([y.sum()]), np.array([True]), rng, 3)
        expected = plain_split(x, y)
        assert abs(score[0] - expected[0]) < 1e-9
        left = x[:, f[0]] <= cuts[f[0]][place[0]]
        assert (left == (bins[:, f[0]] <= place[0])).all()


def test_a_deep_tree_knows_its_bag():
    rng = np.random.default_rng(5)
    x = rng.permutation(np.repeat(np.arange(30.0), 4)).reshape(-1, 1) + np.zeros((1, 2))
    y = (x[:, 0] % 3 == 0).astype(float)
    cuts = forest.quantile_cuts(x)
    tree = forest.grow_tree(forest.binned(x, cuts), y, cuts, rng, 24, 2000, 1)
    node = np.zeros(len(x), int)
    for _ in range(25):
        f = tree["feature"][node]
        low = x[np.arange(len(x)), np.maximum(f, 0)] <= tree["cut"][node]
        node = np.where(f >= 0, np.where(low, tree["left"][node], tree["right"][node]), node)
    assert (tree["value"][node] == y).all()
    shallow = forest.grow_tree(forest.binned(x, cuts), y, cuts, rng, 1, 2000, 1)
    assert len(shallow["value"]) == 3


def test_forest_learns_saves_and_takes_odd_rows(spark, tmp_path):
    rows = [(i, float(i % 7), float(i * 37 % 11), 1 if i % 7 > 3 else 0) for i in range(700)]
    rows += [(900, None, float("nan"), 1), (901, float("inf"), float("-inf"), 0), (902, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "row_id long, `a.b` double, b double, is_attack int")
    cfg = Settings(forest_trees=8, forest_depth=5)
    ch = models.fit_forest(df, ["a.b", "b"], cfg)
    ch.save(str(tmp_path / "f"))
    again = models.Channel.load(spark, str(tmp_path / "f"))
    again.out = "again"
    got = again.score(ch.score(df)).collect()
    assert len(got) == 703 and all(0 <= r[ch.out] <= 1 and r[ch.out] == r["again"] for r in got)
    assert all((r[ch.out] >= 0.5) == (r.is_attack == 1) for r in got if r.row_id < 700)
    assert len(again.pipeline.trees) == 8


def test_rows_are_bounded_and_may_be_missing(spark):
    df = spark.range(5000).select(F.array(F.col("id").cast("double")).alias("x"), (F.col("id") > 2500).alias("y"))
    assert 250 < forest.drawn(df, F.col("x"), F.col("y"), 400, 1).num_rows < 600
    none = forest.fit(df.limit(0), F.col("x"), F.col("y"), 3, 3)
    assert none.trees == [] and none.score(df.limit(3), F.col("x"), "s").select("s").collect() == [(0.0,)] * 3
    one = forest.fit(df.filter("id = 4000"), F.col("x"), F.col("y"), 3, 3)
    scored = one.score(df.withColumn("x", F.when(F.col("y"), F.col("x"))), F.col("x"), "s")
    assert {(r.y, r.s) for r in scored.select("y", "s").distinct().collect()} == {(True, 1.0), (False, 0.0)}


def test_walk_equals_a_plain_descent():
    """Sums over leaves for tall, lone and saved trees, with gaps and infinities in the rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).round(2)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=3000) > 0).astype(float)
    cuts = forest.quantile_cuts(x)
    trees = [forest.grow_tree(forest.binned(x, cuts), y, cuts, np.random.default_rng(t), 24, 2000, 2) for t in range(5)]
    trees.append({"feature": [-1], "cut": [0.0], "left": [-1], "right": [-1], "value": [0.25]})
    x[5, 1], x[6, 0], x[7, 2] = np.nan, np.inf, -np.inf
    expected = np.zeros(len(x))
    for t in trees:
        for i, row in enumerate(x):
            node = 0
            while t["feature"][node] >= 0:
                node = t["left" if row[t["feature"][node]] <= t["cut"][node] else "right"][node]
            expected[i] += t["value"][node]
    assert (forest.Walk(trees).total(x, "value") == expected).all()
    assert (forest.Walk([]).total(x, "value") == 0).all()


def test_tasks_grow_with_a_file(spark, tmp_path, monkeypatch):
    """What one task of a spread input reads is bounded; before, there were as many tasks as cores at any size."""
    from flowloom import session

    spark.range(50_000).select("id", F.xxhash64("id").alias("h")).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread_small(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SPREAD_BYTES", 10_000)
    spread = session.spread_small(df)
    assert spread.rdd.getNumPartitions() > 20 and spread.count() == 50_000
