"""Expressions on literal rows with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from flowloom.functions import cleaning, network, scoring, text
from flowloom.settings import Settings


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, c {kind}")
    return [r[1] for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_entropy(spark):
    got = values(spark, text.entropy, ["example.com", "aaaa", "", None])
    assert got[0] == pytest.approx(3.095795, abs=1e-6)
    assert got[1:] == [0.0, 0.0, 0.0]


def test_byte_entropy(spark):
    got = values(spark, lambda c: text.byte_entropy(F.encode(c, "UTF-8")), ["aaaa", "ab", "", None])
    assert got == pytest.approx([0.0, 1.0, 0.0, 0.0], abs=1e-9)


def test_dns_name(spark):
    name = ["a.bcd.e.", "", None, "12.x3"]
    assert values(spark, text.dns_label_count, name) == [3, 0, 0, 2]
    assert values(spark, text.dns_longest_label, name) == [3, 0, 0, 2]
    assert values(spark, text.dns_length, name) == [8, 0, 0, 5]
    assert values(spark, text.dns_digit_ratio, name) == [0, 0, 0, 0.6]


def test_uri(spark):
    assert values(spark, text.uri_length, ["/a?b=1"]) == [6]
    assert values(spark, text.uri_slashes, ["/a?b=1", None]) == [1, 0]
    assert values(spark, text.uri_non_alnum_ratio, ["/a?b=1", ""]) == [0.5, 0.0]


def test_numbers(spark):
    items = [" 1.5 ", "abc", None, "NaN", "2d", "3f", "1e3", "inf", "-Infinity"]
    got = values(spark, cleaning.number_or_zero, items)
    assert got == [1.5, 0, 0, 0, 0, 0, 1000, math.inf, -math.inf]


def test_times(spark):
    items = ["2017-07-03 09:00:01", "2017/07/03 09:00", "03/07/2017 08:55:58", "5/7/2017 8:42",
             " none ", "NaT", "", "junk", None]
    got = values(spark, cleaning.parse_timestamp, items)
    shown = [v and v.strftime("%Y-%m-%d %H:%M:%S") for v in got]
    assert shown == ["2017-07-03 09:00:01", "2017-07-03 09:00:00", "2017-07-03 08:55:58",
                     "2017-07-05 08:42:00", None, None, None, None, None]


def test_header_names():
    got = cleaning.clean_header(["﻿ Flow ID", " Fwd Header Length", "Fwd Header Length", "LABEL "])
    assert got == ["Flow ID", "Fwd Header Length", "Fwd Header Length.1", "Label"]
    assert cleaning.clean_header(["label", "Label"]) == ["label", "Label"]


def test_labels(spark):
    items = ["BENIGN", "benign", " BENIGN", "DoS", None]
    assert values(spark, cleaning.is_attack, items) == [0, 0, 1, 1, 1]
    assert values(spark, lambda c: cleaning.attack_class(None, c), items[:4]) == ["BENIGN", "BENIGN", "BENIGN", "ATTACK"]


def test_protocols(spark):
    items = ["6", "6.0", "17", "1", "47", " tcp ", None]
    assert values(spark, network.protocol_token, items) == ["TCP", "TCP", "UDP", "ICMP", "P47", "TCP", None]


def test_addresses(spark):
    items = ["8.8.8.8", "10.0.0.1", "172.32.0.1", "172.31.0.1", "192.168.1.1", "240.0.0.1",
             "169.254.3.3", "1.2.3", "1.2.3.256", "01.2.3.4", "::1", "", None, "100.64.0.1"]
    assert values(spark, network.is_routable, items) == [
        True, False, True, False, False, False, False, False, False, False, False, False, False, True]


def test_map_positions(spark):
    items = ["10.0.0.1", "9.10.0.1", "7.8", "x.y", None]
    assert values(spark, lambda c: F.array(*network.plot_position(c)), items) == [
        [2560, 1], [2314, 1], [7, 8], [0, 0], [0, 0]]


def scores(spark, **given):
    columns = ("l2_rf_attack_score", "l2_lstm_attack_score", "l2_lstm_pkt_score",
               "l2_emb_attack_score", "l2_hdr_cnn_attack_score", "l2_ae_ratio")
    df = spark.createDataFrame([tuple(given.get(c, 0.0) for c in columns)], ", ".join(f"{c} double" for c in columns))
    return df.select(scoring.network_score()).first()[0]


def test_network_score(spark):
    assert scores(spark, l2_rf_attack_score=1.0) == pytest.approx(0.34)
    full = scores(spark, l2_rf_attack_score=1.0, l2_emb_attack_score=1.0, l2_ae_ratio=30.0)
    assert full == pytest.approx(0.569991, abs=1e-6)
    assert scores(spark, l2_ae_ratio=-5.0) == 0.0


def rules(spark, types, row):
    df = spark.createDataFrame([row], types)
    found = scoring.rule_conditions(dict(df.dtypes))
    return df.select(scoring.rule_names(found), F.round(scoring.rule_boost(found), 6)).first()


RULE_TYPES = ("`Flow Packets/s` double, `Flow Bytes/s` double, `SYN Flag Count` double, "
              "`RST Flag Count` double, `Destination Port` string, http_request_uri string")


def test_rules(spark):
    every = rules(spark, RULE_TYPES, (500.0, 400_000.0, 1.0, 1.0, "22", "/Admin"))
    assert len(every[0]) == 5 and every[1] == 0.16
    assert rules(spark, RULE_TYPES, (120.0, 80_000.0, 0.0, 0.0, "443", "/"))[0] == []
    nan = float("nan")
    assert rules(spark, RULE_TYPES, (nan, nan, nan, nan, "443.0", None))[0] == []
    for port in ("n/a", "nan"):
        assert tuple(rules(spark, RULE_TYPES, (500.0, 0.0, 0.0, 0.0, port, "/admin"))) == ([], 0.0)
    # a missing port is as unreadable as a text that is no number
    assert rules(spark, RULE_TYPES, (500.0, 0.0, 0.0, 0.0, None, ""))[0] == []


def test_rule_rates_fall_back(spark):
    got = rules(spark, "`Fwd Packets/s` double, `Bwd Packets/s` double, `Destination Port` int", (250.0, 260.0, 443))
    assert tuple(got) == (["high_packet_rate"], 0.035)


@pytest.mark.parametrize("network_score, failed, changed, score, band", [
    (0.8, 2, 0, 100.0, "Emergency"), (0.5, 0, 1, 60.0, "Medium"), (0.2, 0, 0, 20.0, "Info"), (70.0, 0, 0, 70.0, "High")])
def test_threat(spark, network_score, failed, changed, score, band):
    raw = scoring.threat_score_raw(F.lit(network_score), F.lit(failed), F.lit(changed), Settings())
    row = spark.range(1).select(F.round(raw, 2), scoring.severity(raw)).first()
    assert tuple(row) == (score, band)


def test_softmax_and_probability(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "z array<double>").withColumn("p", scoring.softmax(F.col("z")))
    p, attack, top = df.select("p", scoring.attack_probability(F.col("p"), ["A", "benign", "C"]),
                               scoring.attack_probability(F.col("p"), ["A", "B", "C"])).first()
    total = sum(math.exp(v) for v in (1, 2, 3))
    assert p == pytest.approx([math.exp(v) / total for v in (1, 2, 3)])
    assert attack == pytest.approx(1 - p[1]) and top == pytest.approx(p[2])
