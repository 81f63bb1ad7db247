"""Random forest grown from binned features, every tree on a bag as large as the labelled table.

Rows are cut once into bins by the quantiles of all labelled rows: one byte a value. Trees grow
level by level, by sums over bins. A small table is sent to every task and a task grows whole
trees; a larger one stays where it is and is split by ``forest_growth``. Rows that are scored
meet the trees as a broadcast where the trees are small; larger trees stay in a table, and the
rows are sent past them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.session import materialize

BINS = 32
TOGETHER = 65_536  # rows whose nodes are split at once; more are taken in groups of nodes
PAIR = float(1 << 26)  # rows and positive rows are summed as one number: rows + PAIR * positive rows
GATHERED = 12_000_000  # values of a table that is sent to every task
SHARED = 256 << 20  # bytes of trees that are sent to every task
NODES = "tree int, feature binary, cut binary, left binary, right binary, value binary"
KINDS = {"feature": np.int16, "cut": np.float64, "left": np.int32, "right": np.int32, "value": np.float32}


def quantile_cuts(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each feature the borders of its bins; a value lies in the bin of the first border not below it."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, f], at, method="lower")) for f in range(x.shape[1])]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def borders(cuts: list[np.ndarray]) -> np.ndarray:
    border = np.zeros((len(cuts), BINS))
    for f, c in enumerate(cuts):
        border[f, : len(c)] = c
    return border


def grow_tree(
    x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, depth: int, bag: int, tried: int
) -> dict[str, np.ndarray]:
    """A tree on ``bag`` rows drawn with replacement; a node tries ``tried`` features that vary in it."""
    weight = np.bincount(rng.integers(0, len(x), bag), minlength=len(x))
    rows = np.flatnonzero(weight)
    w = weight[rows].astype(float)
    return grow(x[rows], w, w * y[rows], np.zeros(len(rows), np.int64), 1, borders(cuts), rng, depth, tried)


def grow(x, w, hits, slot, k, border, rng, depth, tried) -> dict[str, np.ndarray]:
    """The trees below ``k`` nodes that rows of weight ``w`` lie in (``slot``); those nodes come first."""
    base, levels = 0, []
    for level in range(depth + 1):
        if k > 1 and len(x) > TOGETHER:
            levels.append(_grow_groups(x, w, hits, slot, k, base, border, rng, depth - level, tried))
            break
        total, positive = np.bincount(slot, w, k), np.bincount(slot, hits, k)
        mixed = (positive > 0) & (positive < total) if level < depth else np.zeros(k, bool)
        best, feature, place = _best_splits(x, w, hits, slot, total, positive, mixed, rng, tried)
        split = mixed & np.isfinite(best)
        child = 2 * (np.cumsum(split) - 1)
        levels.append({
            "feature": np.where(split, feature, -1), "cut": np.where(split, border[feature, place], 0.0),
            "left": np.where(split, base + k + child, -1), "right": np.where(split, base + k + child + 1, -1),
            "value": positive / np.maximum(total, 1),
        })
        going = np.flatnonzero(split.take(slot))
        x, w, hits, slot = x.take(going, 0), w.take(going), hits.take(going), slot.take(going)
        held = x.ravel().take(np.arange(len(x)) * x.shape[1] + feature.take(slot))
        slot = child.take(slot) + (held > place.take(slot))
        base, k = base + k, 2 * int(split.sum())
        if not k:
            break
    return {n: np.concatenate([v[n] for v in levels]).astype(t) for n, t in KINDS.items()}


def _grow_groups(x, w, hits, slot, k, base, border, rng, depth, tried) -> dict[str, np.ndarray]:
    """``grow`` for neighbouring nodes of about ``TOGETHER`` rows at a time, so that sums over bins stay small."""
    order, ends = np.argsort(slot, kind="stable"), np.cumsum(np.bincount(slot, minlength=k))
    roots, below, first, begin, offset = [], [], 0, 0, base + k
    while first < k:
        last = max(first + 1, int(np.searchsorted(ends, begin + TOGETHER, "right")))
        rows, size = order[begin : ends[last - 1]], last - first
        part = grow(x.take(rows, 0), w.take(rows), hits.take(rows), slot.take(rows) - first, size, border, rng, depth, tried)
        for side in ("left", "right"):
            part[side] = np.where(part[side] >= 0, part[side] + (offset - size), -1)
        roots.append({n: v[:size] for n, v in part.items()})
        below.append({n: v[size:] for n, v in part.items()})
        first, begin, offset = last, ends[last - 1], offset + len(part["value"]) - size
    return {n: np.concatenate([v[n] for v in roots + below]) for n in KINDS}


def purity(n, p, total, positive):
    """Squared class counts over sizes of both sides, of which the left one has ``n`` rows and ``p`` positive ones."""
    m, q = total - n, positive - p
    score = (p * p + (n - p) ** 2) / np.maximum(n, 1) + (q * q + (m - q) ** 2) / np.maximum(m, 1)
    score[(n == 0) | (m == 0)] = -np.inf
    return score


def _best_splits(x, w, hits, slot, total, positive, mixed, rng, tried):
    """Score, feature and last bin to the left of the purest split of each mixed node."""
    k, features = len(total), x.shape[1]
    best, feature, place = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64)
    found, order, chance = np.zeros(k, np.int64), np.zeros((k, features), np.int64), rng.random((k, features))
    order[mixed] = chance[mixed].argsort(1)
    values, s, begins, both = x.ravel(), slot, np.arange(len(x)) * features, w + hits * PAIR
    asked, going = np.arange(k), mixed
    for turn in range(features):
        if not going.all():  # rows of nodes that are done are left behind
            number = np.where(going, np.cumsum(going) - 1, -1)
            s = number.take(s)
            mine = np.flatnonzero(s >= 0)
            asked, s, begins, both = asked[going], s.take(mine), begins.take(mine), both.take(mine)
        if not len(asked):
            break
        at = begins + order[asked, turn].take(s)
        cells = np.bincount(s * BINS + values.take(at), both, len(asked) * BINS)
        filled = np.flatnonzero(cells)  # behind an empty bin the score stays what it was
        node = filled // BINS
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        sizes, sums = np.diff(starts, append=len(node)), cells.take(filled).cumsum()
        sums -= (sums.take(starts) - cells.take(filled.take(starts))).repeat(sizes)
        p = np.floor(sums / PAIR)
        score = purity(sums - p * PAIR, p, total[asked].take(node), positive[asked].take(node))
        top, at = np.maximum.reduceat(score, starts), np.empty(len(asked), np.int64)
        tops = np.flatnonzero(score == top.repeat(sizes))[::-1]
        at[node.take(tops)] = filled.take(tops) % BINS  # the first of equal ones is written last
        found[asked] += np.isfinite(top)
        better = top > best[asked]
        won = asked[better]
        best[won], feature[won], place[won] = top[better], order[won, turn], at[better]
        going = found[asked] < tried
    return best, feature, place


def ranked(x: np.ndarray, cuts: dict[int, np.ndarray]) -> np.ndarray:
    """For each row and feature the number of cuts below its value."""
    ranks = np.zeros((len(x), max(cuts, default=0) + 1), np.int64)
    for f, c in cuts.items():
        ranks[:, f] = np.searchsorted(c, x[:, f], "left")
    return ranks


class Walk:
    """Trees made ready for many rows: a node is one number of child, feature and cut.

    The cuts of all trees are ranked by feature, so rows are ranked once and then compared by
    rank. Children of a node lie side by side; a leaf is its own child with a cut that no rank passes.
    Ranks and features take the bits they need, the rest is left to the places of children.
    """

    def __init__(self, trees: list[dict[str, np.ndarray]], cuts: dict[int, np.ndarray] | None = None):
        self.trees, self.packed, self.cuts, self.ready = trees, [], dict(cuts or {}), {}
        self.ranks, self.features = 1, 1  # bits
        trees = [{k: np.asarray(v) for k, v in t.items()} for t in trees]
        self.trees = trees
        if not trees:
            return
        if cuts is None:
            feature, cut = (np.concatenate([t[k] for t in trees]) for k in ("feature", "cut"))
            for f in np.unique(feature[feature >= 0]):
                self.cuts[int(f)] = np.unique(cut[feature == f])
        self.ranks = max((len(c) for c in self.cuts.values()), default=1).bit_length()
        self.features = max(max(self.cuts, default=0).bit_length(), 1)
        never = (1 << self.ranks) - 1
        for t in trees:
            f, own = t["feature"].astype(np.int64), np.arange(len(t["feature"]))
            rank = np.full(len(f), never, np.int64)
            for k, c in self.cuts.items():
                mine = np.flatnonzero(f == k)
                rank[mine] = np.searchsorted(c, t["cut"][mine])
            place, child = self._side_by_side(f >= 0, t["left"], t["right"], own)
            node = (child << (self.ranks + self.features)) | (np.maximum(f, 0) << self.ranks) | rank
            moved = np.empty(len(f), np.int64)
            moved[place] = node
            self.packed.append((moved, place))

    @staticmethod
    def _side_by_side(inner, left, right, own):
        """New places of nodes such that a right child follows its left one, and each node's left child there."""
        place = np.zeros(len(own), np.int64)
        parents = own[inner]
        first = 1 + 2 * np.arange(len(parents))
        place[left[parents]], place[right[parents]] = first, first + 1
        child = place.copy()
        child[parents] = first
        return place, child

    def total(self, x: np.ndarray, out: str) -> np.ndarray:
        """For each row the sum of ``out`` over the leaves it comes to."""
        return self.total_of_ranks(ranked(x, self.cuts), out)

    def held(self, out: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each tree its packed nodes, which of them are leaves, and their ``out``."""
        if out not in self.ready:
            self.ready[out] = []
            for tree, (packed, place) in zip(self.trees, self.packed):
                values = np.empty(len(place), tree[out].dtype)
                values[place] = tree[out]
                leaf = (packed >> (self.ranks + self.features)) == np.arange(len(packed))
                self.ready[out].append((packed, leaf, values))
        return self.ready[out]

    def only(self, out: str) -> Walk:
        """Without what sums of ``out`` do not need."""
        self.held(out)
        self.trees = self.packed = None
        return self

    def total_of_ranks(self, ranks: np.ndarray, out: str) -> np.ndarray:
        flat, total = ranks.ravel(), np.zeros(len(ranks))
        begins = np.arange(len(ranks)) * ranks.shape[1]
        shift, features, rank = self.ranks + self.features, (1 << self.features) - 1, (1 << self.ranks) - 1
        for packed, leaf, values in self.held(out):
            node, rows, at = np.zeros(len(ranks), np.int64), np.arange(len(ranks)), begins
            now = node
            while len(rows):
                for _ in range(4):
                    held = packed.take(now)
                    now = (held >> shift) + (flat.take(at + ((held >> self.ranks) & features)) > (held & rank))
                done = leaf.take(now)
                node[rows[done]] = now[done]
                rows, now = rows[~done], now[~done]
                at = begins.take(rows)
            total += values.take(node)
        return total


@dataclass
class HistogramForest:
    """Trees as arrays; the score of a row is the mean share of positive rows in its leaves, without features 0.

    Trees of more than ``SHARED`` bytes stay in a table, ``stored``, a row each, and ``trees`` is None.
    """

    trees: list[dict[str, np.ndarray]] | None
    stored: DataFrame | None = None

    @staticmethod
    def of(nodes: DataFrame) -> HistogramForest:
        sizes = sum((F.octet_length(n).cast("long") for n in KINDS), F.lit(0))
        held = nodes.agg(F.coalesce(F.sum(sizes), F.lit(0))).first()[0]
        return HistogramForest(None, nodes) if held > SHARED else HistogramForest(_collected(nodes))

    def count(self) -> int:
        return self.stored.count() if self.trees is None else len(self.trees)

    def score(self, df: DataFrame, x: Column, out: str) -> DataFrame:
        if self.trees is None:
            return _score_stored(self.stored, df, x, out)
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        ready = []

        @F.pandas_udf("double")
        def rate(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            known = vectors.notna().to_numpy()
            if not known.any():
                return pd.Series(np.zeros(len(vectors)))
            if not ready:  # once in a Python worker's task
                ready.append(Walk(shared.value))
            total = ready[0].total(np.stack(vectors[known].to_numpy()), "value")
            out = np.zeros(len(vectors))
            out[known] = total / max(len(shared.value), 1)
            return pd.Series(out)

        return df.withColumn(out, rate(x))

    def save(self, spark: SparkSession, path: str) -> None:
        if self.trees is None:
            nodes = self.stored
        else:
            nodes = spark.createDataFrame([node_row(i, t) for i, t in enumerate(self.trees)], NODES)
        nodes.write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> HistogramForest:
        return HistogramForest.of(spark.read.parquet(f"{path}/trees"))


def node_row(number: int, tree: dict[str, np.ndarray]) -> tuple:
    return (number, *(bytearray(tree[n].tobytes()) for n in KINDS))


def node_batch(number: int, tree: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int32()), *(pa.array([tree[n].tobytes()], pa.binary()) for n in KINDS)]
    return pa.RecordBatch.from_arrays(columns, names=["tree", *KINDS])


def _tree(row: dict) -> dict[str, np.ndarray]:
    return {n: np.frombuffer(row[n], t) for n, t in KINDS.items()}


def _collected(nodes: DataFrame) -> list[dict[str, np.ndarray]]:
    return [_tree(r) for r in nodes.toArrow().sort_by("tree").to_pylist()]


# --- scoring with trees that stay in a table ---

ROW, MEAN = "_forest_row", "_forest_mean"
FEW_RECORDS = 8  # of rows or trees, in an Arrow batch


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of a table of large rows, one in memory at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield from b.slice(i, 1).to_pylist()


@contextmanager
def few_records(spark: SparkSession) -> Iterator[None]:
    """Python steps read a few records at a time: a record is a tree or many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(FEW_RECORDS))
        yield
    finally:
        spark.conf.set(key, before)


def _used_cuts(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each feature the cuts that any tree has."""

    def pairs(batches):
        for r in records(batches):
            t = _tree(r)
            inner = t["feature"] >= 0
            for f in np.unique(t["feature"][inner]):
                at = np.unique(t["cut"][inner & (t["feature"] == f)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), f, np.int32)), pa.array(at)], names=["feature", "cut"])

    found: dict[int, list] = {}
    for r in nodes.mapInArrow(pairs, "feature int, cut double").distinct().collect():
        found.setdefault(r["feature"], []).append(r["cut"])
    return {f: np.sort(np.array(c)) for f, c in found.items()}


def _score_stored(nodes: DataFrame, df: DataFrame, x: Column, out: str) -> DataFrame:
    """The rows' ranks are sent past groups of trees of about ``SHARED`` bytes; sums come back to the rows."""
    sc = df.sparkSession.sparkContext
    cuts = _used_cuts(nodes)
    wide = max(cuts, default=0) + 1
    kind = np.uint8 if max((len(c) for c in cuts.values()), default=0) < 256 else np.int32
    sizes = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("value")).alias("most")).first()
    count = sizes["n"]
    # a node takes 4 bytes in ``value``, about 16 in a walk
    each = max(1, min(SHARED // max(1, 4 * sizes["most"]), -(-count // sc.defaultParallelism)))
    groups = -(-count // each)
    known = sc.broadcast(cuts)
    held = materialize(df.withColumn(ROW, F.monotonically_increasing_id()))

    def rows_ranked(batches):
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if b.num_rows:
                values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                ids = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1], pa.int32()), pa.array([ids[0]], pa.int64()),
                     pa.array([ranked(values, known.value).astype(kind).tobytes()], pa.binary()),
                     pa.array([ids.tobytes()], pa.binary())], names=["kind", "at", "a", "b"])

    def past_trees(batches):
        group, trees = None, []
        for r in records(batches):
            if r["g"] != group:
                group, trees = r["g"], []
            if r["kind"] == 0:
                trees.append(Walk([pickle.loads(r["a"])], known.value).only("value"))
                continue
            ranks = np.frombuffer(r["a"], kind).reshape(-1, wide).astype(np.int64)
            total = np.zeros(len(ranks))
            for t in trees:
                total += t.total_of_ranks(ranks, "value")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["at"]]), pa.array([group], pa.int32()), pa.array([r["b"]], pa.binary()),
                 pa.array([total.tobytes()], pa.binary())], names=["at", "g", "ids", "total"])

    def packed(batches):
        for r in records(batches):
            numbers = [pa.array([r["tree"] // each], pa.int32()), pa.array([0], pa.int32()), pa.array([r["tree"]], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*numbers, pa.array([pickle.dumps(_tree(r))], pa.binary()), pa.array([b""], pa.binary())],
                names=["g", "kind", "at", "a", "b"])

    def added(table: pa.Table) -> pa.Table:
        parts = table.sort_by("g")
        total = sum(np.frombuffer(t) for t in parts.column("total").to_pylist())
        ids = np.frombuffer(parts.column("ids")[0].as_py(), np.int64)
        return pa.table({ROW: ids, MEAN: total / count})

    piece = "kind int, at long, a binary, b binary"
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    rows = materialize(held.select(ROW, x.alias("x")).mapInArrow(rows_ranked, piece))
    sent = nodes.mapInArrow(packed, f"g int, {piece}").unionByName(rows.select(every, "*"))
    sums = sent.repartition(groups, "g").sortWithinPartitions("g", "kind", "at").mapInArrow(
        past_trees, "at long, g int, ids binary, total binary")
    with few_records(df.sparkSession):
        scores = materialize(sums.groupBy("at").applyInArrow(added, f"{ROW} long, {MEAN} double"))
    return held.join(scores, ROW, "left").withColumn(out, F.coalesce(F.col(MEAN), F.lit(0.0))).drop(ROW, MEAN)


# --- fitting ---

CHUNK = 50_000
CHUNKS = "part int, chunk int, rows int, width int, x binary, y binary"


def _labelled(df: DataFrame, x: Column, positive: Column) -> DataFrame:
    # single precision would merge neighbouring cuts: doubles, 8 bytes a feature
    return df.select(x.alias("x"), positive.cast("boolean").alias("y")).filter("y is not null")


def drawn(df: DataFrame, x: Column, positive: Column, rows: int, seed: int) -> pa.Table:
    """About ``rows`` labelled rows by a hash of what they hold and where they lie; all of a smaller table.

    For looking at a table; no forest is fitted on it.
    """
    data = _labelled(df, x, positive)
    total = data.count()
    if total > rows:
        chance = F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id(), F.lit(seed)), F.lit(1 << 31))
        data = data.filter(chance < int(rows / total * (1 << 31)))
    return data.toArrow()


def _chunks(batches):
    """Records of about ``CHUNK`` rows, known by partition and place in it."""
    part, number, held = TaskContext.get().partitionId(), 0, []

    def record():
        rows = sum(b.num_rows for b in held)
        x = b"".join(b.column(0).flatten().to_numpy(zero_copy_only=False).tobytes() for b in held)
        y = b"".join(b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() for b in held)
        numbers = [pa.array([n], pa.int32()) for n in (part, number, rows, len(x) // 8 // rows)]
        return pa.RecordBatch.from_arrays(
            [*numbers, pa.array([x], pa.binary()), pa.array([y], pa.binary())],
            names=["part", "chunk", "rows", "width", "x", "y"])

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield record()
            number, held = number + 1, []
    if held:
        yield record()


def fit(
    df: DataFrame, x: Column, positive: Column, trees: int = 200, depth: int = 24, seed: int = 42
) -> HistogramForest:
    """Fit on all labelled rows; the bag of a tree is as large as their number.

    Rows without a label are left out. Without rows there are no trees, and every score is 0.
    """
    from flowloom.operators import forest_growth

    spark = df.sparkSession
    chunks = materialize(_labelled(df, x, positive).mapInArrow(_chunks, CHUNKS))
    held = chunks.agg(F.sum(F.col("rows").cast("long")).alias("rows"), F.max("width").alias("width")).first()
    if not held["rows"]:
        return HistogramForest([])
    rows, width = held["rows"], held["width"]
    tried = max(1, int(np.sqrt(width)))
    if rows * width > GATHERED:
        with few_records(spark):
            return HistogramForest.of(forest_growth.grown(chunks, rows, width, trees, depth, tried, seed))
    found = chunks.select("x", "y").toArrow()
    values = np.frombuffer(b"".join(found.column("x").to_pylist())).reshape(rows, width)
    y = np.frombuffer(b"".join(found.column("y").to_pylist()), np.uint8).astype(float)
    cuts = quantile_cuts(values)
    shared = spark.sparkContext.broadcast((binned(values, cuts), y, cuts))

    def grow_trees(batches):
        for b in batches:
            for tree in b.column(0).to_pylist():
                x, y, cuts = shared.value
                yield node_batch(tree, grow_tree(x, y, cuts, np.random.default_rng([seed, tree]), depth, len(y), tried))

    slots = spark.sparkContext.defaultParallelism
    return HistogramForest.of(materialize(spark.range(0, trees, 1, min(trees, 4 * slots)).mapInArrow(grow_trees, NODES)))
