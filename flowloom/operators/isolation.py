"""Isolation forest: trees grown in parallel on small samples, scored by batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowloom.operators.forest import Walk
from flowloom.operators.skew import exact_quantile
from flowloom.session import materialize

NODES = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, out)


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> dict[str, list]:
    """Random splits until points are alone, alike, or the depth is reached."""
    feature, cut, left, right, depth = [], [], [], [], []

    def leaf(level: int, size: int) -> None:
        feature.append(-1)
        cut.append(0.0)
        depth.append(float(level + average_path(size)))

    pending = [(np.arange(len(x)), 0, -1, False)]
    while pending:
        rows, level, parent, is_right = pending.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        left.append(-1)
        right.append(-1)
        part = x[rows]
        spread = part.max(axis=0) - part.min(axis=0) if len(rows) else np.zeros(x.shape[1])
        choices = np.flatnonzero(spread > 0)
        if level >= max_depth or len(rows) <= 1 or not len(choices):
            leaf(level, len(rows))
            continue
        f = int(rng.choice(choices))
        low, high = part[:, f].min(), part[:, f].max()
        at = float(rng.uniform(low, high))
        goes_left = part[:, f] <= at
        if goes_left.all():  # rounding put the cut on the largest value
            at = float(low)
            goes_left = part[:, f] <= at
        feature.append(f)
        cut.append(at)
        depth.append(0.0)
        pending.append((rows[~goes_left], level + 1, node, True))
        pending.append((rows[goes_left], level + 1, node, False))
    return {"feature": feature, "cut": cut, "left": left, "right": right, "depth": depth}


@dataclass
class IsolationForest:
    """Fitted trees (at most ``trees`` × twice the sample nodes) and the cut-off."""

    features: list[str]
    trees: list[dict]
    sample_size: int
    threshold: float | None = None

    def score(self, df: DataFrame, out: str = "anomaly_score") -> DataFrame:
        """Adds the anomaly score in (0, 1); larger is more isolated."""
        shared = df.sparkSession.sparkContext.broadcast(
            [{k: np.asarray(v) for k, v in t.items()} for t in self.trees]
        )
        norm = float(average_path(self.sample_size)) or 1.0
        ready = []

        @F.pandas_udf("double")
        def rate(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            if not ready:  # once in a Python worker's task
                ready.append(Walk(shared.value))
            total = ready[0].total(np.stack(vectors.to_numpy()), "depth")
            return pd.Series(np.exp2(-total / max(len(shared.value), 1) / norm))

        return df.withColumn(out, rate(feature_array(self.features)))

    def flag(self, df: DataFrame, out: str = "is_anomaly", score: str = "anomaly_score") -> DataFrame:
        """Adds the score and whether it lies beyond the cut-off."""
        return self.score(df, score).withColumn(out, F.col(score) > F.lit(self.threshold))

    def covers(self, columns: list[str]) -> bool:
        return set(self.features) <= set(columns)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (i, t["feature"], t["cut"], t["left"], t["right"], t["depth"])
            for i, t in enumerate(self.trees)
        ]
        spark.createDataFrame(rows, NODES).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame(
            [(self.features, self.sample_size, self.threshold)],
            "features array<string>, sample_size int, threshold double",
        ).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForest:
        meta = spark.read.parquet(f"{path}/meta").first()
        return IsolationForest(
            list(meta["features"]),
            _collect_trees(spark.read.parquet(f"{path}/trees")),
            meta["sample_size"],
            meta["threshold"],
        )


def bounded(column: Column) -> Column:
    """A double with infinities cut to ±1e12 and gaps as 0."""
    bound = F.lit(1e12)
    return F.greatest(-bound, F.least(bound, F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))))


def feature_array(features: list[str]) -> Column:
    """Bounded doubles of the feature columns."""
    return F.array(*[bounded(F.col(f"`{c}`")) for c in features])


def _collect_trees(nodes: DataFrame) -> list[dict]:
    return [
        {k: list(r[k]) for k in ("feature", "cut", "left", "right", "depth")}
        for r in nodes.orderBy("tree").collect()
    ]


def tree_samples(
    df: DataFrame, features: list[str], key: str, trees: int, sample: int, seed: int
) -> DataFrame:
    """(tree, x): for every tree its own random rows, at most ``sample`` of them.

    One pass over the whole table. Trees need about 1.5 * trees * sample drawn rows
    together. A large table is filtered by a hash of the row's key to about that many,
    each for one tree; in a small one every row draws for as many trees, one
    from each of equal ranges of trees.
    """
    rows = df.select(F.col(key).alias("_key"), feature_array(features).alias("x"))
    wanted = 1.5 * trees * sample / max(rows.count(), 1)
    draws = max(1, min(trees, int(np.ceil(wanted))))
    share = F.lit(float(1 << 31))

    def chance(*parts) -> Column:
        return F.pmod(F.xxhash64("_key", *parts), F.lit(1 << 31)) / share

    if wanted < 1:
        rows = rows.filter(chance(F.lit(seed - 1)) < wanted)
    drawn = rows.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    place = (F.col("_d") + chance("_d", F.lit(seed))) * (trees / draws)
    drawn = drawn.withColumn("tree", F.least(F.floor(place).cast("int"), F.lit(trees - 1)))
    # a rank with a limit: each task keeps ``sample`` rows of a tree at most
    order = Window.partitionBy("tree").orderBy(F.xxhash64("_key", "tree", F.lit(seed + 1)), "_key")
    return (
        drawn.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= sample)
        .select("tree", "_n", "x")
    )


def fit(
    df: DataFrame,
    features: list[str],
    key: str = "row_id",
    trees: int = 200,
    sample: int = 256,
    contamination: float = 0.02,
    seed: int = 42,
    limit: int | None = None,
) -> IsolationForest:
    """Fit on a table; the cut-off flags ``contamination`` of its rows."""
    max_depth = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("_n")["x"].to_numpy())
        nodes = grow_tree(x, np.random.default_rng([seed, tree]), max_depth)
        return pd.DataFrame([{"tree": tree, **nodes}])

    grown = tree_samples(df, features, key, trees, sample, seed).groupBy("tree").applyInPandas(grow, NODES)
    size = min(sample, df.limit(sample).count())
    model = IsolationForest(features, _collect_trees(grown), size)
    # the quantile reads the scores several times: score once
    scores = materialize(model.score(df).select("anomaly_score"))
    model.threshold = exact_quantile(scores, "anomaly_score", 1 - contamination, limit)
    return model
