"""Retention of a growing flow buffer: keep the newest rows, archive the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIB = 1024 * 1024


def csv_bytes(columns: list[str]) -> Column:
    """Bytes of a row as a CSV line with its line end."""
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return F.octet_length(F.concat_ws(",", *values)) + 1


def header_line_bytes(columns: list[str]) -> int:
    return len(",".join(columns).encode()) + 1


def buffer_sizes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, bytes of all of them with the header, longest row."""
    columns = columns or df.columns
    b = csv_bytes(columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.coalesce(F.sum(b), F.lit(0)) + header_line_bytes(columns)).alias("total_bytes"),
        F.coalesce(F.max(b), F.lit(0)).alias("longest_row"),
    )


PARTS = 1024  # ranges of ids counted in one pass


def tail_cut(
    df: DataFrame,
    keep_rows: int = 0,
    keep_bytes: int = 0,
    order: str = "row_id",
    columns: list[str] | None = None,
    limit: int | None = None,
) -> int | None:
    """Smallest id of the longest newest tail within both limits (0: no limit); None where no row has an id.

    An order statistic weighted by bytes: rows and bytes are summed for ``limit`` ranges of
    ids, and the range in which a limit breaks is counted again in finer ones until it is
    one id. No row is sorted or moved. The newest id always stays.
    """
    key = F.col(f"`{order}`")
    if dict(df.dtypes)[order] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"rows are cut by whole numbers, {order} holds {dict(df.dtypes)[order]}")
    rows = df.select(key.cast("long").alias("id"), csv_bytes(columns or df.columns).cast("long").alias("b"))
    none = F.col("id").isNull()
    low, high, n, size = rows.agg(
        F.min("id"), F.max("id"), F.count_if(none), F.coalesce(F.sum(F.when(none, F.col("b"))), F.lit(0))
    ).first()
    if low is None:
        return None
    size += header_line_bytes(columns or df.columns)
    cut, parts = high, max(2, limit or PARTS)
    while True:
        width = -(-(high - low + 1) // parts)
        part = F.call_function("div", F.col("id") - F.lit(low), F.lit(width).cast("long"))
        counted = (
            rows.filter(F.col("id").between(low, high)).groupBy(part.alias("p"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).orderBy(F.desc("p")).collect()
        )
        for r in counted:
            if (keep_rows > 0 and n + r.n > keep_rows) or (keep_bytes > 0 and size + r.b > keep_bytes):
                break
            n, size, cut = n + r.n, size + r.b, min(cut, low + r.p * width)
        else:
            return cut
        if width == 1:
            return cut
        low, high = low + r.p * width, min(high, low + (r.p + 1) * width - 1)


def mark_tail(
    df: DataFrame,
    keep_rows: int = 0,
    keep_bytes: int = 0,
    order: str = "row_id",
    columns: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows with ``kept``: the longest newest tail within both limits (0: no limit).

    The newest row always stays. The byte limit counts the header line. Rows of one id
    stay or go together; rows without an id count as the newest and stay.
    """
    if keep_rows <= 0 and keep_bytes <= 0:
        return df.withColumn("kept", F.lit(True))
    cut = tail_cut(df, keep_rows, keep_bytes, order, columns, limit)
    key = F.col(f"`{order}`")
    return df.withColumn("kept", F.lit(True) if cut is None else key.isNull() | (key >= cut))


def retention_plan(
    df: DataFrame,
    keep_rows: int = 0,
    keep_bytes: int = 0,
    order: str = "row_id",
    columns: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One row: rows kept and archived, and whether the byte goal is out of reach."""
    columns = columns or df.columns
    marked = mark_tail(df, keep_rows, keep_bytes, order, columns, limit)
    longest = F.max(csv_bytes(columns)) + header_line_bytes(columns)
    return marked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("kept").alias("tail_keep"),
        F.count_if(~F.col("kept")).alias("archived"),
        (F.count_if(~F.col("kept")) > 0).alias("needs_action"),
        (F.lit(keep_bytes > 0) & (longest > keep_bytes)).alias("goal_unreachable"),
    )


def apply_retention(marked: DataFrame, keep_path: str, archive_path: str) -> None:
    """Two writes: the kept tail, and the retired rows added to the archive."""
    marked.filter("kept").drop("kept").write.mode("overwrite").parquet(keep_path)
    marked.filter(~F.col("kept")).drop("kept").write.mode("append").parquet(archive_path)
