"""Suppression: the fixed cases, and slices against a plain loop."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from flowloom.operators.suppression import scan, suppress
from flowloom.streaming.suppression import LastKept

BASE = dt.datetime(2024, 1, 1)


def loop(alerts, window):
    """Row by row: keep when later than the last kept by more than the window."""
    last, kept = {}, []
    for seq, key, t in sorted(alerts):
        if key in last and t - last[key] <= window:
            continue
        last[key] = t
        kept.append(seq)
    return kept


def frame(spark, alerts):
    rows = [(s, k, "High", BASE + dt.timedelta(seconds=t)) for s, k, t in alerts]
    return spark.createDataFrame(rows, "alert_seq long, ip string, severity string, ts timestamp").repartition(6)


def test_scan_keeps_the_fixed_case():
    kept, last = scan(np.array([0, 10, 31, 60, 62]), None, 30)
    assert kept == [0, 2, 4] and last == 62


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slices_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    alerts = []
    for i in range(900):
        # a third of all alerts share a key; times repeat and run out of order
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(30)}"
        t = i // 3 + rng.choice([0, 0, 0, -40, 5]) if seed > 1 else i // 3
        alerts.append((i, key, t))
    expected = loop(alerts, 25)
    df = frame(spark, alerts)
    plain = [r.alert_seq for r in suppress(df, 25).collect()]
    sliced = [r.alert_seq for r in suppress(df, 25, limit=20).collect()]
    assert sorted(plain) == expected
    assert sorted(sliced) == expected


def test_chain_without_gaps_needs_every_slice(spark):
    # alerts one second apart: the kept chain runs through all slices
    alerts = [(i, "hot", i) for i in range(400)]
    got = [r.alert_seq for r in suppress(frame(spark, alerts), 6, limit=15).collect()]
    assert sorted(got) == list(range(0, 400, 7))


def test_missing_time_counts_as_now(spark):
    rows = [(1, "a", "x", BASE), (2, "a", "x", None), (3, "a", "x", None)]
    df = spark.createDataFrame(rows, "alert_seq long, ip string, severity string, ts timestamp")
    kept = suppress(df, 60, now=BASE + dt.timedelta(hours=1))
    assert sorted(r.alert_seq for r in kept.collect()) == [1, 2]


def test_no_window_keeps_all(spark):
    df = frame(spark, [(1, "a", 0), (2, "a", 0)])
    assert suppress(df, 0).count() == 2


class State:
    """A state value that counts its reads and writes."""

    def __init__(self):
        self.held, self.reads, self.writes = None, 0, 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        self.reads += 1
        return self.held

    def update(self, value):
        self.writes += 1
        self.held = value


def test_keys_of_a_bucket_share_one_state():
    rng, state, kept = random.Random(5), State(), []
    names = [("a", "High"), ("a", None), (None, "High"), *[(f"k{i}", "Low") for i in range(40)]]
    alerts = [(i, rng.choice(names), i // 4 + rng.choice([0, 0, -9])) for i in range(900)]
    processor = LastKept(6)
    processor.init(state)
    for at in (0, 300, 600):
        part = pd.DataFrame([(i, *who, t) for i, who, t in alerts[at : at + 300]], columns=["alert_seq", "ip", "severity", "us"])
        for found in processor.handleInputRows((7,), iter([part[150:], part[:150]]), None):
            kept += found["alert_seq"].tolist()
            assert found.columns.tolist() == ["alert_seq", "ip", "severity"]
    assert sorted(kept) == loop(alerts, 6)
    assert state.reads <= 2 and state.writes <= 3
