"""Grouped and ordered work that stays spread out when one group is huge.

Spark puts a whole window partition into one task. That is right while groups
are small, and wrong when one address, flow or bucket holds a large share of
all rows. The helpers here look at group sizes first:

* every group within ``limit`` rows: the plain Spark window, one shuffle;
* groups beyond it: those rows alone are range-partitioned by (keys, order)
  into slices, written once to the shared checkpoint folder so the slice
  borders stay fixed, and what crosses a border (a rank offset, a running
  total, the last few rows) is carried from slice to slice in a table with
  one row per slice.

Nothing is dropped or capped on either way, so both give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from flowloom.session import materialize

GROUP_LIMIT = 1_000_000  # rows of one group that may share a task
MAX_SLICES = 10_000
MAX_HOT_GROUPS = 100_000  # so a table of hot groups is always small enough to broadcast
BROADCAST_BYTES = 64 * 1024 * 1024

# Column names, "-" in front for descending; nulls come last ascending and first
# descending, so the two are exact opposites. The last one must be unique, so
# that slices can be cut anywhere.
Order = list[str]


def sort_columns(order: Order, opposite: bool = False) -> list[Column]:
    columns = []
    for item in order:
        descending = item.startswith("-") != opposite
        column = F.col(f"`{item.removeprefix('-')}`")
        columns.append(column.desc_nulls_first() if descending else column.asc_nulls_last())
    return columns


@dataclass
class Split:
    """Rows of ordinary groups, rows of huge groups, and the huge groups' keys."""

    cold: DataFrame
    hot: DataFrame | None
    hot_keys: DataFrame | None
    hot_rows: int


def lookup_by(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", small: bool = False
) -> DataFrame:
    """Join on null-safe keys, keeping only the left side's key columns."""
    r = right.select(
        *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & left[f"`{k}`"].eqNullSafe(r[f"_key{i}"])
    joined = left.join(F.broadcast(r) if small else r, cond, how)
    return joined.drop(*[f"_key{i}" for i in range(len(keys))]) if how not in (
        "left_semi",
        "left_anti",
    ) else joined


def split_hot(df: DataFrame, keys: list[str], limit: int | None = None) -> Split:
    """Separate the groups too large for one task (one partial aggregation)."""
    limit = limit or GROUP_LIMIT
    if not keys:
        total = df.count()
        if total <= limit:
            return Split(df, None, None, 0)
        return Split(df.limit(0), df, None, total)
    counts = df.groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias("_n"))
    top, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    if top is None or top <= limit:
        return Split(df, None, None, 0)
    # at most MAX_HOT_GROUPS groups can hold more than total / MAX_HOT_GROUPS rows
    cut = max(limit, total // MAX_HOT_GROUPS)
    hot_counts = counts.filter(F.col("_n") > cut)
    hot_rows = hot_counts.agg(F.sum("_n")).first()[0] or 0
    if hot_rows == 0:
        return Split(df, None, None, 0)
    hot_keys = hot_counts.drop("_n")
    return Split(
        lookup_by(df, hot_keys, keys, "left_anti", small=True),
        lookup_by(df, hot_keys, keys, "left_semi", small=True),
        hot_keys,
        int(hot_rows),
    )


def _slices(hot: DataFrame, keys: list[str], order: Order, rows: int, limit: int) -> DataFrame:
    """Hot rows with a fixed ``_slice``, increasing along (keys, order)."""
    n = max(2, min(MAX_SLICES, math.ceil(rows / limit)))
    ranged = hot.repartitionByRange(n, *_cols(keys), *sort_columns(order))
    return materialize(ranged.withColumn("_slice", F.spark_partition_id()))


def _cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def row_positions(
    df: DataFrame, keys: list[str], order: Order, out: str, limit: int | None = None
) -> DataFrame:
    """1-based position of each row in its group (all rows when no keys)."""
    limit = limit or GROUP_LIMIT
    split = split_hot(df, keys, limit)
    plain = split.cold.withColumn(
        out, F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy(*sort_columns(order))).cast("long")
    )
    if split.hot is None:
        return plain
    rows = _slices(split.hot, keys, order, split.hot_rows, limit)
    before = Window.partitionBy(*_cols(keys)).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.groupBy(*_cols(keys), "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*_cols(keys), "_slice").orderBy(*sort_columns(order)))
    ranked = (
        lookup_by(rows.withColumn("_in", inside), offsets, keys + ["_slice"], small=True)
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_slice", "_in", "_before")
    )
    return plain.unionByName(ranked) if keys else ranked


def running_totals(
    df: DataFrame, order: Order, outputs: dict[str, str], limit: int | None = None
) -> DataFrame:
    """Running sums (output name to value column) over all rows in order."""
    limit = limit or GROUP_LIMIT
    split = split_hot(df, [], limit)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if split.hot is None:
        whole = Window.orderBy(*sort_columns(order)).rowsBetween(*upto)
        return df.withColumns({n: F.sum(v).over(whole) for n, v in outputs.items()})
    rows = _slices(split.hot, [], order, split.hot_rows, limit)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_slice").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in outputs.items()])
    offsets = sums.select(
        "_slice",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in outputs],
    )
    inside = (
        Window.partitionBy("_slice").orderBy(*sort_columns(order)).rowsBetween(*upto)
    )
    # one row per slice, at most MAX_SLICES
    return (
        rows.withColumns({n: F.sum(v).over(inside) for n, v in outputs.items()})
        .join(F.broadcast(offsets), "_slice")
        .withColumns({n: F.col(f"_b_{n}") + F.col(n) for n in outputs})
        .drop("_slice", *[f"_b_{n}" for n in outputs])
    )


def trailing_frame(
    df: DataFrame,
    keys: list[str],
    order: Order,
    previous: int,
    outputs: dict[str, Callable[[WindowSpec], Column]],
    limit: int | None = None,
    plain_only: bool = False,
) -> DataFrame:
    """Window expressions over each row and its ``previous`` predecessors.

    ``plain_only`` skips the size check where the caller has made it already.
    """
    limit = limit or GROUP_LIMIT
    split = Split(df, None, None, 0) if plain_only else split_hot(df, keys, limit)
    frame = Window.partitionBy(*_cols(keys)).orderBy(*sort_columns(order)).rowsBetween(-previous, 0)
    plain = split.cold.withColumns({n: fn(frame) for n, fn in outputs.items()})
    if split.hot is None:
        return plain
    rows = _slices(split.hot, keys, order, split.hot_rows, limit)
    columns = [c for c in rows.columns if c != "_slice"]
    part = Window.partitionBy(*_cols(keys), "_slice")
    from_end = F.row_number().over(part.orderBy(*sort_columns(order, opposite=True)))
    # the last rows of every slice, as one array in order
    tails = (
        rows.withColumn("_r", from_end)
        .filter(F.col("_r") <= previous)
        .groupBy(*_cols(keys), "_slice")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct((-F.col("_r")).alias("_o"), F.struct(*_cols(columns)).alias("_row"))
                ),
                _by_first,
            ).alias("_tail")
        )
    )
    earlier = Window.partitionBy(*_cols(keys)).orderBy("_slice").rowsBetween(-previous, -1)
    carried = (
        tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(earlier)))
        .filter(F.size("_all") > 0)
        .select(
            "_slice",
            F.explode(
                F.slice(
                    "_all",
                    F.greatest(F.size("_all") - previous + 1, F.lit(1)),
                    F.lit(previous),
                )
            ).alias("_e"),
        )
        .select("_slice", "_e._row.*")
        .withColumn("_carried", F.lit(True))
    )
    whole = rows.withColumn("_carried", F.lit(False)).unionByName(carried)
    sliced = (
        Window.partitionBy(*_cols(keys), "_slice").orderBy(*sort_columns(order)).rowsBetween(-previous, 0)
    )
    done = (
        whole.withColumns({n: fn(sliced) for n, fn in outputs.items()})
        .filter(~F.col("_carried"))
        .drop("_carried", "_slice")
    )
    return plain.unionByName(done) if keys else done


def _by_first(a: Column, b: Column) -> Column:
    return F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)


def group_counts(
    df: DataFrame,
    keys: list[str],
    outputs: dict[str, Column],
    limit: int | None = None,
    plain_only: bool = False,
) -> DataFrame:
    """Whole-group aggregates put beside every row of the group."""
    split = Split(df, None, None, 0) if plain_only else split_hot(df, keys, limit)
    whole = Window.partitionBy(*_cols(keys))
    plain = split.cold.withColumns({n: a.over(whole) for n, a in outputs.items()})
    if split.hot is None:
        return plain
    totals = split.hot.groupBy(*_cols(keys)).agg(*[a.alias(n) for n, a in outputs.items()])
    return plain.unionByName(lookup_by(split.hot, totals, keys, small=True))


def within_bytes(df: DataFrame, row_bytes: int, budget: int | None = None) -> bool:
    """Whether a table measured now fits the broadcast budget.

    ``row_bytes`` stands for a row without its texts, whose bytes are summed.
    """
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    size = F.lit(row_bytes).cast("long")
    for t in texts:
        size = size + t
    total = df.agg(F.sum(size)).first()[0]
    return (total or 0) <= (budget or BROADCAST_BYTES)


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    row_bytes: int = 64,
    limit: int | None = None,
    budget: int | None = None,
) -> DataFrame:
    """Left join of a fact table to a table with one row per key.

    A dimension counted within the byte budget is broadcast. Beyond it, the
    facts of huge keys meet their few dimension rows by broadcast (at most
    ``MAX_HOT_GROUPS`` of them) and all other keys by a shuffle join.
    """
    if within_bytes(dim, row_bytes, budget):
        return lookup_by(facts, dim, keys, small=True)
    split = split_hot(facts, keys, limit)
    joined = lookup_by(split.cold, dim, keys)
    if split.hot is None:
        return joined
    few = lookup_by(dim, split.hot_keys, keys, "left_semi", small=True)
    small = within_bytes(few, row_bytes, budget)
    return joined.unionByName(lookup_by(split.hot, few, keys, small=small))


def order_statistics(
    df: DataFrame, column: str, ranks: list[int], limit: int | None = None
) -> list[float]:
    """Exact values at 0-based ranks of a numeric column without a full sort.

    Each pass brackets a rank with approximate percentiles and keeps the rows
    inside the bracket, until those fit one task; equal borders end it early.
    """
    limit = limit or GROUP_LIMIT
    values = df.select(F.col(f"`{column}`").cast("double").alias("_x")).filter(
        F.col("_x").isNotNull()
    )
    return [_order_statistic(values, r, limit) for r in ranks]


def _order_statistic(values: DataFrame, rank: int, limit: int) -> float:
    inside, below, count = values, 0, values.count()
    while count > limit:
        target = (rank - below + 0.5) / count
        lo, hi = inside.agg(
            F.percentile_approx(
                "_x", [max(0.0, target - 0.002), min(1.0, target + 0.002)], 10_000
            )
        ).first()[0]
        x = F.col("_x")
        under, at_lo, at_hi, within = inside.agg(
            F.count_if(x < lo), F.count_if(x == lo), F.count_if(x == hi),
            F.count_if(x.between(lo, hi)),
        ).first()
        first, last = below + under, below + under + within
        if rank < first:
            inside, count = inside.filter(x < lo), under
        elif rank >= last:
            inside, below, count = inside.filter(x > hi), last, count - under - within
        elif rank < first + at_lo:
            return float(lo)
        elif rank >= last - at_hi:
            return float(hi)
        else:
            inside = inside.filter((x > lo) & (x < hi))
            below, count = first + at_lo, within - at_lo - at_hi
    ranked = inside.withColumn("_r", F.row_number().over(Window.orderBy("_x")))
    return float(ranked.filter(F.col("_r") == rank - below + 1).first()["_x"])


def exact_quantile(df: DataFrame, column: str, q: float, limit: int | None = None) -> float | None:
    """Quantile with linear interpolation between neighbours."""
    count = df.filter(F.col(f"`{column}`").isNotNull()).count()
    if count == 0:
        return None
    if count <= (limit or GROUP_LIMIT):
        return float(df.agg(F.percentile(F.col(f"`{column}`").cast("double"), q)).first()[0])
    place = q * (count - 1)
    low = math.floor(place)
    high = min(low + 1, count - 1)
    ranks = [low] if low == high or place == low else [low, high]
    found = order_statistics(df, column, ranks, limit)
    return found[0] if len(found) == 1 else found[0] + (found[1] - found[0]) * (place - low)
