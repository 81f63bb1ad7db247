"""Slices, limits and class-wise splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowloom.functions.cleaning import name
from flowloom.operators.skew import order_statistics, row_positions

EXACT = 1 << 53  # whole numbers below it are exact as doubles


def keyed_hash(column: str, seed: int) -> Column:
    """Reproducible random order of rows: MD5 of the row id and the seed."""
    return F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))))


def limit_rows(df: DataFrame, limit: int, order: str = "row_id") -> DataFrame:
    """First rows in table order; 0 or less means all of them."""
    return df if limit <= 0 else df.orderBy(order).limit(limit)


def chunk_keys(df: DataFrame, rows: int, order: str = "row_id") -> DataFrame:
    """Chunk number of each row, for runs that keep statistics per chunk."""
    return df.withColumn("chunk", F.floor(F.col(order) / rows).cast("long"))


def capped_sample(df: DataFrame, group: str, cap: int, seed: int = 42) -> DataFrame:
    """Up to ``cap`` rows per group, the same ones on every run."""
    # a rank with a limit: each task sends on ``cap`` rows of a group at most
    order = Window.partitionBy(F.col(f"`{group}`")).orderBy(keyed_hash("row_id", seed), "row_id")
    ranked = df.withColumn("_p", F.row_number().over(order))
    return ranked.filter(F.col("_p") <= cap).drop("_p")


def training_slice(
    benign: DataFrame,
    attacks: DataFrame,
    benign_rows: int = 35_000,
    attack_rows: int = 6_000,
    seed: int = 42,
) -> DataFrame:
    """First rows of the benign file and capped attack rows of each other file.

    ``attacks`` carries its file in ``source_file``.
    """
    label = F.upper(F.trim(name("Label")))
    head = benign.orderBy("row_id").limit(benign_rows)
    picked = capped_sample(attacks.filter(label != "BENIGN"), "source_file", attack_rows, seed)
    return head.unionByName(picked, allowMissingColumns=True)


def stratified_split(
    df: DataFrame, label: str, ratio: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, about ``ratio`` of every class held out.

    Each row draws its side from a hash of its id, so classes need no shuffle
    and a class of one row simply lands on one side.
    """
    salted = F.concat_ws(":", F.col("row_id").cast("string"), F.lit(str(seed)), F.col(f"`{label}`").cast("string"))
    draw = F.conv(F.substring(F.md5(salted), 1, 8), 16, 10).cast("long") % 10_000
    held = draw < int(ratio * 10_000)
    return df.filter(~held), df.filter(held)


def positional_split(
    df: DataFrame,
    ratio: float = 0.2,
    order: tuple[str, ...] = ("row_id",),
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """First rows for training, the last ``ratio`` for validation."""
    total = df.count()
    cut = int(total * (1 - ratio))
    if len(order) == 1 and 0 < cut < total and df.schema[order[0]].dataType == T.LongType():
        low, high = df.agg(F.min(order[0]), F.max(order[0])).first()
        if -EXACT < low and high < EXACT:  # one exact order statistic, and the rows stay where they are
            last = order_statistics(df, order[0], [cut - 1], limit)[0]
            return df.filter(F.col(order[0]) <= int(last)), df.filter(F.col(order[0]) > int(last))
    placed = row_positions(df, [], list(order), "_p", limit)
    return (
        placed.filter(F.col("_p") <= cut).drop("_p"),
        placed.filter(F.col("_p") > cut).drop("_p"),
    )
