"""Suppression of repeated alerts.

An alert is dropped when it is not more than the window after the last *kept*
alert of its (ip, severity), in arrival order; so the anchor moves only on
keeping, which no fixed window frame can say. The scan runs over partitions
sorted by group and arrival, on Arrow batches of three plain columns.

Only the first alert of a (group, time) can be kept, so repeats are dropped by
a partial aggregation before anything is grouped. A group that is still huge
is cut into slices scanned side by side. What a slice needs from the one
before it is a single number, the time of the last kept alert; slices whose
number turns out different are scanned again until none changes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.functions.cleaning import micros
from flowloom.operators import skew
from flowloom.session import materialize

KEYS = ("ip", "severity")


def scan(times: np.ndarray, last: int | None, window: int) -> tuple[list[int], int | None]:
    """Positions kept among times in arrival order, and the last kept time."""
    kept: list[int] = []
    highest = np.maximum.accumulate(times)
    at = 0 if last is None else int(np.searchsorted(highest, last + window, side="right"))
    while at < len(times):
        kept.append(at)
        last = int(times[at])
        at = int(np.searchsorted(highest, last + window, side="right"))
    return kept, last


def _entry(pdf: pd.DataFrame) -> int | None:
    value = pdf["_entry"].iloc[0]
    return None if pd.isna(value) else int(value)


def _scan_runs(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Kept rows of a partition sorted by group and arrival, batch by batch."""
    group, last = None, None
    for batch in batches:
        if batch.empty:
            continue
        names = batch["_group"].to_numpy()
        times = batch["_us"].to_numpy(np.int64)
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
        kept: list[int] = []
        for start, end in zip(edges, edges[1:]):
            if names[start] != group:
                group, last = names[start], None
            found, last = scan(times[start:end], last, window)
            kept += [start + i for i in found]
        yield pd.DataFrame({"_seq": batch["_seq"].to_numpy()[kept]})


def suppress(
    alerts: DataFrame,
    window_seconds: int,
    keys: tuple[str, ...] = KEYS,
    seq: str = "alert_seq",
    ts: str = "ts",
    now: dt.datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Alerts that survive; one without a time counts as raised at ``now``."""
    if window_seconds <= 0:
        return alerts
    limit = limit or skew.GROUP_LIMIT
    window = int(window_seconds * 1_000_000)
    keys = list(keys)
    fallback = int((now or dt.datetime.now()).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    narrow = (
        alerts.select(
            *[F.col(f"`{k}`") for k in keys],
            F.coalesce(micros(F.col(ts)), F.lit(fallback).cast("long")).alias("_us"),
            F.col(seq).cast("long").alias("_seq"),
        )
        .groupBy(*keys, "_us")
        .agg(F.min("_seq").alias("_seq"))
    )
    split = skew.split_hot(narrow, keys, limit)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq", kind="stable")
        kept, _ = scan(pdf["_us"].to_numpy(np.int64), _entry(pdf), window)
        return pd.DataFrame({"_seq": pdf["_seq"].to_numpy()[kept]})

    def keep_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _scan_runs(batches, window)

    # sorted partitions instead of a Python call per group: groups are many and small
    group = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]))
    sorted_rows = (
        split.cold.select(group.alias("_group"), "_seq", "_us")
        .repartition("_group")
        .sortWithinPartitions("_group", "_seq")
    )
    kept = sorted_rows.mapInPandas(keep_sorted, "_seq long")
    if split.hot is not None:
        rows, entries = _resolve_slices(split, keys, window, limit)
        with_entry = skew.lookup_by(rows, entries, keys + ["_slice"], small=True)
        kept = kept.unionByName(
            with_entry.groupBy(*keys, "_slice").applyInPandas(keep, "_seq long")
        )
    survivors = kept.withColumnRenamed("_seq", seq)
    return alerts.join(survivors, seq, "left_semi")


def _resolve_slices(
    split: skew.Split, keys: list[str], window: int, limit: int
) -> tuple[DataFrame, DataFrame]:
    """Slices of the huge groups and the right entry time of each."""
    rows = skew._slices(split.hot, keys, ["_seq"], split.hot_rows, limit)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    state_type = f"{fields}, _slice int, _entry long, _exit long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq", kind="stable")
        entry = _entry(pdf)
        _, last = scan(pdf["_us"].to_numpy(np.int64), entry, window)
        out = pdf[keys + ["_slice"]].head(1).copy()
        out["_entry"] = pd.array([entry], dtype="Int64")
        out["_exit"] = pd.array([last], dtype="Int64")
        return out

    def scanned(todo: DataFrame) -> DataFrame:
        return todo.groupBy(*keys, "_slice").applyInPandas(run, state_type)

    # one row per (huge group, slice): at most MAX_SLICES + MAX_HOT_GROUPS rows
    state = materialize(scanned(rows.withColumn("_entry", F.lit(None).cast("long"))))
    before = Window.partitionBy(*keys).orderBy("_slice")
    while True:
        linked = state.withColumn("_next", F.lag("_exit").over(before))
        differs = ~F.col("_next").eqNullSafe(F.col("_entry"))
        stale = linked.filter(differs).select(*keys, "_slice", F.col("_next").alias("_entry"))
        if stale.isEmpty():
            return rows, state.select(*keys, "_slice", "_entry")
        again = scanned(skew.lookup_by(rows, stale, keys + ["_slice"], "inner", small=True))
        state = materialize(linked.filter(~differs).drop("_next").unionByName(again))
