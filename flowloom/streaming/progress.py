"""Progress over a growing table: the last id done, guarded by fingerprints.

Ids only have to grow with arrival; they may have gaps. A new run starts after the
last id already processed, unless the part processed before no longer looks the
same; then it starts over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.functions.text import row_fingerprint

STATE = "generation long, rows_done long, last_id long, head string, boundary string, interior string"
WATCHED = 4


def watched_ids(df: DataFrame, last_id: int, position: str = "row_id") -> list[int]:
    """A few ids of the processed part, drawn by hash and so spread over all of it."""
    at = F.col(position)
    inside = df.filter(at <= last_id).select(at.alias("p"))
    ends = inside.agg(F.min("p"), F.max("p")).first()
    drawn = inside.filter(~F.col("p").isin(*ends)) if ends[0] is not None else inside
    order = F.md5(F.col("p").cast("string"))
    return sorted(r["p"] for r in drawn.orderBy(order, "p").limit(WATCHED).collect())


def prefix_digest(df: DataFrame, last_id: int, generation: int, position: str = "row_id") -> DataFrame:
    """One state row for the rows up to ``last_id``: how many, and fingerprints of a few."""
    at = F.col(position)
    done = df.filter(at <= last_id)
    rows, first, last = done.agg(F.count(at), F.min(at), F.max(at)).first()
    inside = watched_ids(df, last_id, position)
    columns = [F.col(f"`{c}`") for c in df.columns]
    wanted = [p for p in (first, last) if p is not None] + inside
    picked = done.filter(at.isin(*wanted)).select(at.alias("p"), row_fingerprint(columns).alias("fp"))

    def one(p: int | None) -> Column:
        return F.max(F.when(F.col("p") == F.lit(p).cast("long"), F.col("fp")))

    sampled = F.array_sort(F.collect_list(F.when(F.col("p").isin(*inside), F.struct("p", "fp"))))
    joined = F.array_join(F.transform(sampled, lambda r: r["fp"]), "|")
    return picked.agg(
        F.lit(generation).cast("long").alias("generation"),
        F.lit(rows).cast("long").alias("rows_done"),
        F.lit(last).cast("long").alias("last_id"),
        one(first).alias("head"),
        one(last).alias("boundary"),
        (F.sha2(joined, 256) if inside else F.lit(None).cast("string")).alias("interior"),
    )


def start_position(df: DataFrame, state: DataFrame, generation: int, position: str = "row_id") -> DataFrame:
    """One row: the first id to process, the rows there are, the last id, and why it starts over."""
    schema = "start long, total long, last long, restart string"
    saved = state.first()
    total, last = df.agg(F.count(position), F.max(position)).first()
    if saved is None:
        return df.sparkSession.createDataFrame([(0, total, last, None)], schema)
    done = saved["last_id"] if saved["last_id"] is not None else -1
    now = prefix_digest(df, done, generation, position).first()
    checks = (
        ("generation changed", saved["generation"] != generation),
        ("table shrank", total < saved["rows_done"]),
        ("head row changed", _differs(saved["head"], now["head"])),
        ("boundary row changed", _differs(saved["boundary"], now["boundary"])),
        ("interior rows changed", _differs(saved["interior"], now["interior"])),
    )
    reason = next((text for text, failed in checks if failed), None)
    return df.sparkSession.createDataFrame([(0 if reason else done + 1, total, last, reason)], schema)


def _differs(saved: str | None, now: str | None) -> bool:
    return bool(saved) and saved != now


def new_rows(df: DataFrame, start: int, position: str = "row_id") -> DataFrame:
    """Rows not processed yet; the filter reaches the scan."""
    return df.filter(F.col(position) >= start)
