"""Forest growth on tables that are too large for one task.

Rows lie in chunks, one record each. Bins come from exact quantiles, counted in eight passes. A bag
is a Poisson weight for each row, drawn anew wherever a chunk is read, so it is stored nowhere. Nodes of
more than ``HOME`` values are split side by side for all trees by sums over bins that the tasks send;
then the rows of each smaller node are sent to one task, some trees at a time, which grows what is below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.operators import forest
from flowloom.operators.forest import BINS, KINDS, NODES, PAIR, records
from flowloom.session import materialize, scratch_path

HOME = 24_000_000  # values of the rows of a node that one task takes
WAVE = 4 << 30  # bytes of rows that are sent at once
POISSON = np.searchsorted(
    np.cumsum([exp(-1) / factorial(i) for i in range(12)]) * 65536, np.arange(65536) + 0.5).astype(np.uint8)


# --- bins ---


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(bits: np.ndarray) -> np.ndarray:
    top = np.uint64(1 << 63)
    return np.where(bits & top, bits & ~top, ~bits).view(np.float64)


def exact_cuts(chunks: DataFrame, rows: int, width: int) -> list[np.ndarray]:
    """The borders that ``quantile_cuts`` finds. Each pass counts the next byte of the values that begin like a border."""
    sc = chunks.sparkSession.sparkContext
    at = np.floor((rows - 1) * np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.int64)
    rank, found = np.tile(at, (width, 1)), np.zeros((width, len(at)), np.uint64)
    for shift in range(56, -1, -8):
        shared = sc.broadcast([np.unique(b) for b in found])

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heads = shared.value
            sums = [np.zeros(len(h) * 256, np.int64) for h in heads]
            for b in batches:
                for x in b.column(0):
                    bits = _ordered(np.frombuffer(x.as_buffer()).reshape(-1, width).T.copy())
                    for f, h in enumerate(heads):
                        digit = ((bits[f] >> np.uint64(shift)) & np.uint64(255)).astype(np.int64)
                        if shift < 56:
                            head = bits[f] >> np.uint64(shift + 8)
                            i = np.minimum(np.searchsorted(h, head), len(h) - 1)
                            digit = (i * 256 + digit)[h[i] == head]
                        sums[f] += np.bincount(digit, minlength=len(sums[f]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array([s.tobytes() for s in sums], pa.binary())],
                names=["f", "n"])

        def summed(t: pa.Table) -> pa.Table:
            n = sum(np.frombuffer(b, np.int64) for b in t.column("n").to_pylist())
            return pa.table({"f": t.column("f")[:1], "n": pa.array([n.tobytes()], pa.binary())})

        sums = chunks.select("x").mapInArrow(counted, "f int, n binary").groupBy("f").applyInArrow(summed, "f int, n binary")
        for r in sums.toArrow().to_pylist():
            f, n = r["f"], np.frombuffer(r["n"], np.int64).reshape(-1, 256).cumsum(1)
            mine = n[np.searchsorted(shared.value[f], found[f])]
            digit = (mine <= rank[f][:, None]).sum(1)
            rank[f] -= np.where(digit > 0, mine[np.arange(len(at)), digit - 1], 0)
            found[f] = (found[f] << np.uint64(8)) | digit.astype(np.uint64)
    return [np.unique(_value(b)) for b in found]


# --- the upper part of a tree, held by the driver ---


@dataclass
class Node:
    """A node of the upper part and, while it is split, the features still to be tried."""

    level: int
    low: np.ndarray  # bins that can occur by the splits above
    high: np.ndarray
    total: int
    hits: int
    feature: int = -1
    place: int = 0
    left: int = -1
    right: int = -1
    order: list[int] = field(default_factory=list)
    found: int = 0
    best: tuple = (-np.inf,)  # score, feature, place, rows and hits to the left


@dataclass
class Upper:
    rng: np.random.Generator
    nodes: list[Node]
    open: list[int]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array([getattr(n, a) for n in self.nodes], np.int32) for a in ("feature", "place", "left", "right"))

    def begin(self, i: int, depth: int) -> None:
        """Keep node ``i`` open if it is too large for one task and can be split."""
        n = self.nodes[i]
        if n.level < depth and n.total * len(n.low) > HOME and 0 < n.hits < n.total:
            n.order = [int(f) for f in self.rng.permutation(len(n.low)) if n.low[f] < n.high[f]]
            self.open.append(i)

    def take(self, i: int, asked: list[int], n: np.ndarray, p: np.ndarray, tried: int, depth: int) -> None:
        """Sums over bins of the features asked for; a node that has tried enough of them is split."""
        node = self.nodes[i]
        score = forest.purity(n.cumsum(1)[:, :-1], p.cumsum(1)[:, :-1], node.total, node.hits)
        for a, f in enumerate(asked):
            if node.found < tried:
                at = int(score[a].argmax())
                node.found += bool(np.isfinite(score[a, at]))
                if score[a, at] > node.best[0]:
                    node.best = (score[a, at], f, at, int(n[a, : at + 1].sum()), int(p[a, : at + 1].sum()))
        node.order = node.order[len(asked):]
        if node.found < tried and node.order:
            return
        self.open.remove(i)
        if not np.isfinite(node.best[0]):
            return
        _, node.feature, node.place, rows, hits = node.best
        for side, total, positive in (("left", rows, hits), ("right", node.total - rows, node.hits - hits)):
            low, high = node.low.copy(), node.high.copy()
            if side == "left":
                high[node.feature] = node.place
            else:
                low[node.feature] = node.place + 1
            setattr(node, side, len(self.nodes))
            self.nodes.append(Node(node.level + 1, low, high, total, positive))
            self.begin(len(self.nodes) - 1, depth)

    def below(self, depth: int) -> list[int]:
        """Nodes that tasks go on with."""
        return [i for i, n in enumerate(self.nodes)
                if n.feature < 0 and n.level < depth and n.total * len(n.low) <= HOME and 0 < n.hits < n.total]

    def tree(self, border: np.ndarray) -> dict[str, np.ndarray]:
        feature, place, left, right = self.arrays()
        value = np.array([n.hits / max(n.total, 1) for n in self.nodes])
        cut = np.where(feature >= 0, border[np.maximum(feature, 0), place], 0.0)
        parts = {"feature": feature, "cut": cut, "left": left, "right": right, "value": value}
        return {n: parts[n].astype(t) for n, t in KINDS.items()}


def _weights(seed: int, tree: int, part: int, chunk: int, rows: int) -> np.ndarray:
    return POISSON[np.random.default_rng([seed, tree, part, chunk]).integers(0, 65536, rows, np.uint16)]


def _reached(upper: tuple[np.ndarray, ...], x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The node of the upper part that each of ``rows`` comes to."""
    feature, place, left, right = upper
    node, live, now = np.zeros(len(rows), np.int64), np.arange(len(rows)), np.zeros(len(rows), np.int64)
    begins, values = rows * x.shape[1], x.ravel()
    while len(live):
        f = feature.take(now)
        if (f < 0).any():
            inner = np.flatnonzero(f >= 0)
            live, now, f, begins = live.take(inner), now.take(inner), f.take(inner), begins.take(inner)
        now = np.where(values.take(begins + f) <= place.take(now), left.take(now), right.take(now))
        node[live] = now
    return node


def _chunk(r: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["x"], np.uint8).reshape(-1, width), np.frombuffer(r["y"], np.uint8)


def _totals(data: DataFrame, trees: int, seed: int) -> dict[int, tuple[int, int]]:
    """Weight of all rows and of positive ones in each bag."""

    def weighed(batches):
        n = np.zeros((2, trees), np.int64)
        for r in records(batches):
            y = np.frombuffer(r["y"], np.uint8)
            for t in range(trees):
                w = _weights(seed, t, r["part"], r["chunk"], r["rows"])
                n[:, t] += w.sum(dtype=np.int64), w[y > 0].sum(dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(trees, dtype=np.int32)), pa.array(n[0]), pa.array(n[1])], names=["tree", "n", "p"])

    sums = data.select("part", "chunk", "rows", "y").mapInArrow(weighed, "tree int, n long, p long")
    return {r["tree"]: (r["n"], r["p"]) for r in sums.groupBy("tree").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()}


def _split_round(data: DataFrame, uppers: list[Upper], width: int, tried: int, depth: int, seed: int) -> None:
    """One pass: sums over bins for the open nodes of all trees."""
    asks = {}
    for t, u in enumerate(uppers):
        if u.open:
            # one more than needed, as one may turn out not to vary
            asked = {i: u.nodes[i].order[: tried - u.nodes[i].found + 1] for i in u.open}
            most = max(len(a) for a in asked.values())
            number = np.full(len(u.nodes), -1)
            number[list(asked)] = np.arange(len(asked))
            padded = np.array([a + a[:1] * (most - len(a)) for a in asked.values()], np.int64)
            asks[t] = (u.arrays(), number, padded, asked)
    shared = data.sparkSession.sparkContext.broadcast({t: a[:3] for t, a in asks.items()})

    def counted(batches):
        sums = {t: np.zeros((2, a[2].size * BINS), np.int64) for t, a in shared.value.items()}
        for r in records(batches):
            x, y = _chunk(r, width)
            for t, (upper, number, padded) in shared.value.items():
                w = _weights(seed, t, r["part"], r["chunk"], len(x))
                rows = np.flatnonzero(w)
                s = number.take(_reached(upper, x, rows))
                if (s < 0).any():
                    open_rows = np.flatnonzero(s >= 0)
                    rows, s = rows.take(open_rows), s.take(open_rows)
                weight = w.take(rows).astype(float)
                both, begins, values = weight + weight * y.take(rows) * PAIR, rows * width, x.ravel()
                for a in range(padded.shape[1]):
                    key = (s * padded.shape[1] + a) * BINS + values.take(begins + padded[:, a].take(s))
                    pairs = np.bincount(key, both, sums[t].shape[1])
                    hits = np.floor(pairs / PAIR)
                    sums[t][0] += (pairs - hits * PAIR).astype(np.int64)
                    sums[t][1] += hits.astype(np.int64)
        for t, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["tree", "n"])

    def summed(table: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(b, np.int64) for b in table.column("n").to_pylist())
        return pa.table({"tree": table.column("tree")[:1], "n": pa.array([n.tobytes()], pa.binary())})

    columns = "tree int, n binary"
    for r in data.mapInArrow(counted, columns).groupBy("tree").applyInArrow(summed, columns).toArrow().to_pylist():
        _, _, padded, asked = asks[r["tree"]]
        n, p = np.frombuffer(r["n"], np.int64).reshape(2, *padded.shape, BINS)
        for k, (i, a) in enumerate(asked.items()):
            uppers[r["tree"]].take(i, a, n[k, : len(a)], p[k, : len(a)], tried, depth)


def _finished(
    data: DataFrame, uppers: dict[int, Upper], border: np.ndarray, width: int, tried: int, depth: int, seed: int
) -> DataFrame:
    """Whole trees, a row each: what is below the upper parts grows where the rows of its node are sent."""
    spark = data.sparkSession
    tops = {t: (u.arrays(), u.below(depth), u.tree(border), [n.level for n in u.nodes]) for t, u in uppers.items()}
    shared = spark.sparkContext.broadcast(tops)

    def sent(batches):
        for r in records(batches):
            x, y = _chunk(r, width)
            for t, (upper, below, _, levels) in shared.value.items():
                w = _weights(seed, t, r["part"], r["chunk"], len(x))
                weighted = np.flatnonzero(w)
                node = _reached(upper, x, weighted)
                for i in below:
                    rows = weighted if len(levels) == 1 else weighted.take(np.flatnonzero(node == i))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t], pa.int32()), pa.array([i], pa.int32()),
                             *(pa.array([v.take(rows, 0).tobytes()], pa.binary()) for v in (x, y, w))],
                            names=["tree", "node", "x", "y", "w"])

    def grow_node(table: pa.Table) -> pa.Table:
        t, i = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        x, y, w = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8) for c in ("x", "y", "w"))
        w = w.astype(float)
        levels = shared.value[t][3]
        part = forest.grow(
            x.reshape(-1, width), w, w * y, np.zeros(len(y), np.int64), 1, border,
            np.random.default_rng([seed, t, i]), depth - levels[i], tried)
        grown = pa.Table.from_batches([forest.node_batch(t, part)])
        return grown.add_column(1, "node", pa.array([i], pa.int32()))

    def joined(table: pa.Table) -> pa.Table:
        t = table.column("tree")[0].as_py()
        top = shared.value[t][2]
        parts = [{n: v.copy() for n, v in top.items()}]
        offset = len(top["value"])
        for r in table.sort_by("node").to_pylist():
            part = {n: np.frombuffer(r[n], k).copy() for n, k in KINDS.items()}
            for side in ("left", "right"):
                part[side] = np.where(part[side] >= 0, part[side] + (offset - 1), -1).astype(np.int32)
            for n in KINDS:  # the root of the part takes the place of the node
                parts[0][n][r["node"]] = part[n][0]
            parts.append({n: v[1:] for n, v in part.items()})
            offset += len(part["value"]) - 1
        whole = {n: np.concatenate([p[n] for p in parts]) for n in KINDS}
        return pa.Table.from_batches([forest.node_batch(t, whole)])

    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = data.mapInArrow(sent, "tree int, node int, x binary, y binary, w binary").repartition(tasks, "tree", "node")
    pieces = NODES.replace("tree int", "tree int, node int")
    nodes = rows.groupBy("tree", "node").applyInArrow(grow_node, pieces).groupBy("tree").applyInArrow(joined, NODES)
    alone = [forest.node_row(t, top) for t, (_, below, top, _) in tops.items() if not below]
    return nodes.unionByName(spark.createDataFrame(alone, NODES)) if alone else nodes


def grown(chunks: DataFrame, rows: int, width: int, trees: int, depth: int, tried: int, seed: int) -> DataFrame:
    """The trees on all rows of ``chunks``, a row each, on shared storage."""
    spark = chunks.sparkSession
    cuts = exact_cuts(chunks, rows, width)

    def cut_up(batches):
        for r in records(batches):
            x = forest.binned(np.frombuffer(r["x"]).reshape(-1, width), cuts)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[c]], pa.int32()) for c in ("part", "chunk", "rows", "width")),
                 pa.array([x.tobytes()], pa.binary()), pa.array([r["y"]], pa.binary())],
                names=["part", "chunk", "rows", "width", "x", "y"])

    data = materialize(chunks.mapInArrow(cut_up, forest.CHUNKS))
    totals = _totals(data, trees, seed)
    uppers = []
    for t in range(trees):
        high = np.array([len(c) for c in cuts], np.int32)
        u = Upper(np.random.default_rng([seed, t]), [Node(0, np.zeros(width, np.int32), high, *totals[t])], [])
        u.begin(0, depth)
        uppers.append(u)
    while any(u.open for u in uppers):
        _split_round(data, uppers, width, tried, depth, seed)
    path = scratch_path(spark, "forest")
    wave = max(1, WAVE // (rows * (width + 2)))
    for first in range(0, trees, wave):
        some = dict(list(enumerate(uppers))[first : first + wave])
        _finished(data, some, forest.borders(cuts), width, tried, depth, seed).write.mode("append").parquet(path)
    return spark.read.parquet(path)
