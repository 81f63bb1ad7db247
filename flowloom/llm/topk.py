"""Exact top-k search by inner product with multi-resolution segment statistics.

Each vector is cut into segments, at several resolutions from coarse to fine. With the
mean m and the deviation s of each segment, the inner product of two segments of n
components is n * m * m' plus the product of what is left, at most n * s * s'; the sum
over segments bounds a score from above (a distance from below). Per query, candidates
whose bound stays below the k-th best score known so far are left out, resolution by
resolution, and only the rest is computed exactly, in integers.

Queries and candidates meet in blocks: a group holds one block of each. The k-th best
score among a small first block gives every query a score to beat from the start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.llm.common import col, partitions
from flowloom.session import materialize


@dataclass(frozen=True)
class TopK:
    k: int = 5
    query_block: int = 1024
    block: int = 4096
    seeds: int = 1024  # candidates of the first block
    resolutions: tuple[int, ...] = (1, 4, 16)


FOUND = "query_id long, vec_id long, score long"


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations, each scaled by the root of the segment's length."""
    n, dim = x.shape
    edges = [round(i * dim / segments) for i in range(segments + 1)]
    mean, spread = np.empty((n, segments)), np.empty((n, segments))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = x[:, a:b]
        if a == b:
            mean[:, i] = spread[:, i] = 0
            continue
        m = part.mean(axis=1)
        mean[:, i] = m * math.sqrt(b - a)
        spread[:, i] = np.sqrt(np.maximum(((part - m[:, None]) ** 2).sum(axis=1), 0))
    return mean, spread


def best_of_block(q_ids, q, least, c_ids, c, rule: TopK, step: int = 1024):
    """(query, candidate, score) of each query's k best in a block that reach ``least``."""
    # sums of products stay below 2**53 and are exact in floating point, or else are taken in integers
    exact_type = np.float64 if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53 else np.int64
    qx, cx = q.astype(exact_type), c.astype(exact_type)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    levels = [s for s in rule.resolutions if s <= q.shape[1]]
    q_stats = [segment_statistics(qf, s) for s in levels]
    owners, ids, values = [], [], []
    floor = np.where(np.isnan(least), -np.inf, least)
    for at in range(0, len(c), step):
        part = slice(at, at + step)
        alive = np.ones((len(q), len(cf[part])), bool)
        for (qm, qs), s in zip(q_stats, levels):
            rows = np.flatnonzero(alive.any(axis=1))
            if not len(rows):
                break
            cm, cs = segment_statistics(cf[part], s)
            bound = qm[rows] @ cm.T + qs[rows] @ cs.T
            slack = 1e-6 * (1 + np.abs(bound))  # rounding never leaves a candidate out
            alive[rows] &= bound + slack >= floor[rows, None]
        alive &= q_ids[:, None] != c_ids[part][None]
        i, j = np.nonzero(alive)
        if not len(i):
            continue
        if len(i) * 4 > alive.size:
            score = (qx @ cx[part].T)[i, j]
        else:
            score = np.einsum("ij,ij->i", qx[i], cx[part][j])
        owners.append(i)
        ids.append(c_ids[part][j])
        values.append(np.rint(score).astype(np.int64) if exact_type is np.float64 else score)
        o, d, v = (np.concatenate(x) for x in (owners, ids, values))
        order = np.lexsort((d, -v, o))
        o, d, v = o[order], d[order], v[order]
        rank = np.arange(len(o)) - np.searchsorted(o, o)
        keep = rank < rule.k
        owners, ids, values = [o[keep]], [d[keep]], [v[keep]]
        kth = rank == rule.k - 1
        floor[o[kth]] = np.maximum(floor[o[kth]], v[kth])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return q_ids[owners[0]], ids[0], values[0]


def _searched(queries: DataFrame, candidates: DataFrame, rule: TopK) -> DataFrame:
    """Both tables dealt into groups (dim, qb, cb) and searched group by group."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) and len(right):
            q_ids, c_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            q, c = (np.stack([np.asarray(v.values) for v in t.column("v")]) for t in (left, right))
            least = left.column("least").to_numpy().astype(float)
            found = best_of_block(q_ids, q, least, c_ids, c, rule)
        else:
            found = [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    keys = ["dim", "qb", "cb"]
    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(group, FOUND)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): floor(256 * x) of each component; vectors with null or non-finite ones left out."""
    x = F.transform(col("embedding"), lambda c: c.cast("double"))
    base = vectors.select(col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    base = base.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)
    v = F.transform("x", lambda c: F.floor(c * 256).cast("long"))
    return base.select("vec_id", v.alias("v"), F.size("x").alias("dim"))


def top_k(vectors: DataFrame, every: int = 50, rule: TopK = TopK()) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all
    rows with another vec_id and as many components. Rows that are wholly equal count
    once. Rows with a null vec_id take no part. A query without candidates has no rows.
    """
    rows = materialize(whole_numbers(vectors).distinct())
    total = rows.count()
    queries = rows.filter(F.col("vec_id") % every == 0)
    asked = queries.count()
    blocks = max(math.ceil(total / rule.block), 2 * partitions(vectors))
    q_blocks = max(1, math.ceil(asked / rule.query_block))
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int"))
    every_q = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    every_c = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a score to beat: the k-th best of a small block of real candidates
    seeds = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(rule.seeds)
    few = max(1, min(partitions(vectors), rule.seeds // 64))
    first = _searched(
        queries.withColumn("least", F.lit(None).cast("long")).withColumn("cb", every_c(few)),
        seeds.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(few)).cast("int")).withColumn("qb", every_q),
        rule,
    )
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    least = (
        first.withColumn("rank", F.row_number().over(kth)).filter(F.col("rank") == rule.k)
        .select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    )
    asked_rows = materialize(queries.join(least, "vec_id", "left"))
    found = _searched(
        asked_rows.withColumn("cb", every_c(blocks)),
        rows.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("qb", every_q),
        rule,
    )
    return (
        found.distinct().withColumn("rank", F.row_number().over(kth)).filter(F.col("rank") <= rule.k)
        .select("query_id", "rank", "vec_id", "score")
    )
