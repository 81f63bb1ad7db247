"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints are 64-bit SimHashes of 3-word shingles. Equal ones are one entry of
the index. Its upper nodes are masked bit patterns: the 64 bits are cut into
``most + 2`` parts, and two fingerprints that differ in at most ``most`` bits agree
in two parts at least, so they share the node of some pair of parts. Nodes are dealt
out by pattern. Below a node, fingerprints are sorted by Gray rank and factored
further into groups with shared masked patterns; two groups whose patterns already
differ in more bits than allowed are pruned as a whole.

A node with more than ``large`` fingerprints is cut by the remaining bits in the
same way (two cuts at most, after which a node cannot hold more than 2**14), so no
task meets an unbounded one. Each node gives a spanning forest of its links, never
all pairs; components are then found over tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.common import chunks, col, fresh, partitions
from flowloom.llm.graph import components
from flowloom.llm.linededup import with_rid
from flowloom.session import materialize

BITS = 64
LEAF = 16
# for a byte, one 1 in the byte lane of each of its set bits
LANES = np.array([sum(1 << (8 * b) for b in range(8) if x >> b & 1) for x in range(256)], np.uint64)


def simhash_texts(texts: list[str], width: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints of whole texts; no words give 0."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        words = t.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, blanks as in the contract
        if len(words) > width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            hashes.extend([digest(s, seed) for s in shingles])
            sizes.append(len(words) - width + 1)
        elif words:
            hashes.append(digest(b" ".join(words), seed))
            sizes.append(1)
        else:
            sizes.append(0)
    sizes = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h = np.array(hashes, np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    # byte lanes hold up to 255 ones, so sums are taken over runs of at most 255 shingles
    runs = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    inside = np.arange(runs.sum()) - np.repeat(first, runs)
    lanes = LANES[h.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.repeat(starts, runs) + 255 * inside, axis=0)
    counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, BITS).astype(np.int64), first, axis=0)
    on = counts * 2 > sizes[full][:, None]
    out[full] = (on.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; null texts count as empty."""

    def hashed(batches):
        for b in batches:
            ids = b.column(0)
            for start, held in chunks(b.column(1)):
                fp = simhash_texts(held, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(held)), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(col("doc_id").alias("doc_id"), col("text").cast("string").alias("text")).mapInArrow(
        hashed, "doc_id long, fp long"
    )


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray order of 64-bit numbers."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class Forest:
    """Joined groups of the entries 0 to n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


class GrayIndex:
    """Hierarchy over distinct fingerprints in Gray order.

    A group is a run of the order; it knows which bits all of its members share
    (the mask) and their values (the pattern). Runs split in halves down to
    leaves of a few fingerprints.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.both, self.either = {}, {}
        self._build(0, len(fps))

    def _build(self, lo: int, hi: int) -> tuple[int, int]:
        if hi - lo <= LEAF:
            part = self.fps[lo:hi]
            found = int(np.bitwise_and.reduce(part)), int(np.bitwise_or.reduce(part))
        else:
            mid = (lo + hi) // 2
            (a, b), (c, d) = self._build(lo, mid), self._build(mid, hi)
            found = a & c, b | d
        self.both[lo, hi], self.either[lo, hi] = found
        return found

    def link(self, most: int, forest: Forest) -> None:
        """Join all fingerprints that differ in at most ``most`` bits."""
        todo = [((0, len(self.fps)), (0, len(self.fps)))]
        while todo:
            a, b = todo.pop()
            if a != b:
                # bits that are 1 throughout one group and 0 throughout the other
                apart = (self.both[a] & ~self.either[b]) | (self.both[b] & ~self.either[a])
                if apart.bit_count() > most:
                    continue
            small = a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF
            if small:
                x = np.bitwise_count(self.fps[a[0] : a[1], None] ^ self.fps[None, b[0] : b[1]])
                for i, j in zip(*np.nonzero(x <= most)):
                    forest.join(a[0] + int(i), b[0] + int(j))
                continue
            halves = [self._halves(a), self._halves(b)]
            if a == b:
                (p, q) = halves[0]
                todo += [(p, p), (q, q), (p, q)]
            else:
                todo += [(p, q) for p in halves[0] for q in halves[1]]

    @staticmethod
    def _halves(run: tuple[int, int]) -> list[tuple[int, int]]:
        lo, hi = run
        if hi - lo <= LEAF:
            return [run]
        return [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]


def _mask(low: int, high: int) -> int:
    return ((1 << high) - 1) ^ ((1 << low) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def upper_masks(most: int) -> list[int]:
    """Masks of all pairs of ``most + 2`` parts of the bits."""
    edges = [round(i * BITS / (most + 2)) for i in range(most + 3)]
    parts = [_mask(a, b) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(parts, 2)]


def _cut(mask: int, most: int) -> list[int]:
    """Finer masks below a node: the free bits in ``most + 1`` parts, one of which agrees."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [round(i * len(free) / (most + 1)) for i in range(most + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:])]


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint once for each mask, with the bits under the mask."""
    nodes = F.array(*[
        F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern"))
        for m in masks
    ])
    return rows.select("fp", F.explode(nodes).alias("node")).select("node.mask", "node.pattern", "fp")


def index_links(fps: DataFrame, most: int = 2, large: int = 4096) -> DataFrame:
    """Edges (a, b) of a spanning forest of all links between distinct fingerprints.

    ``fps`` has one column fp without repeats.
    """
    masks = upper_masks(most)
    nodes = _dealt(fps, masks)
    found = []
    for _ in range(2):
        sizes = nodes.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large)
        sizes = materialize(sizes.select("mask", "pattern"))
        if sizes.isEmpty():
            break
        # both sides shuffle by node; a large one is split by adaptive execution
        found.append(_links_of(nodes.join(sizes, ["mask", "pattern"], "left_anti"), most))
        big = nodes.join(sizes, ["mask", "pattern"], "left_semi")
        finer = {m: _cut(m, most) for m in masks}
        cut = F.array()
        for m, below in finer.items():
            cut = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)) for x in below])).otherwise(cut)
        nodes = big.select("fp", F.explode(cut).alias("mask")).select(
            "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp"
        )
        nodes = materialize(nodes.distinct())
        masks = sorted({x for below in finer.values() for x in below})
    found.append(_links_of(nodes, most))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _links_of(nodes: DataFrame, most: int) -> DataFrame:
    def linked(batches):
        held = None
        for b in batches:
            part = [np.asarray(b.column(i)) for i in range(3)]
            held = part if held is None else [np.concatenate([x, y]) for x, y in zip(held, part)]
            mask, pattern, fp = held
            if not len(fp):
                continue
            # the last node may go on in the next batch
            last = np.flatnonzero((mask == mask[-1]) & (pattern == pattern[-1]))[0]
            yield from _edges(mask[:last], pattern[:last], fp[:last], most)
            held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield from _edges(*held, most)

    dealt = nodes.repartition(partitions(nodes), "mask", "pattern").sortWithinPartitions("mask", "pattern", "fp")
    return dealt.mapInArrow(linked, "a long, b long")


def _edges(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray, most: int):
    n = len(fp)
    if n < 2:
        return
    new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    values = fp.view(np.uint64)
    a, b = [], []
    small = np.repeat(sizes <= LEAF, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # members from here to the node's end
    for lag in range(1, LEAF):  # nodes that are single leaves, all of them at once
        at = np.flatnonzero(small & (left > lag))
        if not len(at):
            break
        near = np.bitwise_count(values[at] ^ values[at + lag]) <= most
        a.append(fp[at[near]])
        b.append(fp[at[near] + lag])
    for k in np.flatnonzero(sizes > LEAF):
        group = values[starts[k] : starts[k] + sizes[k]]
        group = group[np.argsort(gray_rank(group))]
        forest = Forest(len(group))
        GrayIndex(group).link(most, forest)
        roots = np.array([forest.root(i) for i in range(len(group))])
        move = np.flatnonzero(roots != np.arange(len(group)))
        a.append(group[roots[move]].view(np.int64))
        b.append(group[move].view(np.int64))
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def hex16(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def simhash_groups(docs: DataFrame, most: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows share a fingerprint. Rows with a null doc_id take part, but
    component_id is the smallest doc_id that is not null (null where there is none).
    """
    prints = materialize(fingerprints(docs, width))
    entries = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(index_links(entries.select("fp"), most))
    labelled = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(labelled.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, most: int = 2, width: int = 3) -> DataFrame:
    """One row of each group, all columns kept: the one with the smallest doc_id.

    Rows that repeat doc_id and text are one document, of which one row stays. Rows that
    share doc_id with another text, or have none, are documents of their own and come
    after all others, in an order of their own; they too go where another row of their
    group stays. Null and empty texts are one group.
    """
    rid = fresh(docs, "_rid")
    numbered = with_rid(docs, rid)
    named = numbered.select(col(rid).alias("doc_id"), col("text").alias("text"))
    groups = materialize(simhash_groups(named, most, width))
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(rid))
    rows = numbered.join(kept.distinct(), rid, "left_semi")
    if not kept.groupBy(col(rid)).count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates([rid])
    return rows.drop(rid)
