"""Operators against plain loops on small skewed tables."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from flowloom import catalog
from flowloom.catalog.models import packet_labelled
from flowloom.operators import features, governance, isolation, metrics, models, packets, retention, sampling, schema, traffic
from flowloom.plans.detect import detect
from flowloom.plans.prepare import prepare
from flowloom.plans.retrain import retrain_once
from flowloom.session import COALESCE, materialize
from flowloom.settings import Settings
from flowloom.streaming import progress

BASE = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()))


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(5)
    data = []
    for i in range(300):
        ip = "10.0.0.1" if i % 3 == 0 else f"10.0.1.{rng.randrange(20)}"
        t = None if i % 29 == 0 else BASE + dt.timedelta(seconds=rng.randrange(4000))
        data.append((i, t, ip, "8.8.8.8", 6, 443 if i % 2 else 22, float(i % 500), float(i), 40 if i == 7 else i % 3,
                     i % 2, f"http://h{i % 9}.com/{'x' * (i % 40)}", f"h{i % 9}.com", "DoS" if i % 5 == 0 else "BENIGN"))
    return spark.createDataFrame(
        data,
        "row_id long, Timestamp timestamp, `Source IP` string, `Destination IP` string, Protocol int, `Destination Port` int, "
        "`Flow Packets/s` double, `Flow Bytes/s` double, `SYN Flag Count` int, `RST Flag Count` int, http_request_uri string, "
        "dns_qname string, Label string").repartition(4)


def test_prepare_is_the_same_for_huge_sources(raw):
    plain, split = prepare(raw), prepare(raw, group_limit=25)
    assert rows(plain) == rows(split)
    assert plain.count() == 300


def test_prepare_refuses_missing_columns(raw):
    with pytest.raises(schema.SchemaError, match="Source IP"):
        prepare(raw.drop("Source IP"))
    assert prepare(raw.drop("Source IP"), allow_missing=True).filter("`Source IP` = '0.0.0.0'").count() == 300


def test_absent_uri_gives_zero_features(raw):
    df = features.enrich_http(raw.drop("http_request_uri"))
    assert df.agg(F.max("http_flows_same_ip_60s"), F.max("http_token_len")).first() == (0.0, 0.0)


def test_buckets_are_dense(spark):
    df = spark.createDataFrame([(BASE + dt.timedelta(seconds=10), 1), (BASE + dt.timedelta(seconds=190), 2), (None, 9)],
                               "Timestamp timestamp, `SYN Flag Count` int")
    dense = traffic.dense_buckets(traffic.bucket_totals(df, 60), 60).orderBy("bucket")
    assert [r["SYN_Flag_Count"] for r in dense.collect()] == [1, 0, 0, 2]


def test_spikes_count_empty_buckets(spark):
    stamp = lambda m: BASE + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(stamp(i), 1) for i in range(20)] + [(stamp(20), 500)], "Timestamp timestamp, `SYN Flag Count` int")
    flags = traffic.spike_flags(traffic.bucket_totals(df, 60), 60, 2.0).orderBy("bucket")
    assert [r["l1_syn_spike"] for r in flags.collect()] == [False] * 20 + [True]
    one = traffic.spike_flags(traffic.bucket_totals(df.limit(1), 60), 60, 2.0)
    assert [r["l1_syn_spike"] for r in one.collect()] == [False]
    # two equal buckets a day apart: only the empty ones between make them stand out
    far = spark.createDataFrame([(stamp(0), 5), (stamp(1440), 5)], "Timestamp timestamp, `SYN Flag Count` int")
    assert traffic.spike_flags(traffic.bucket_totals(far, 60), 60, 3.0).filter("l1_syn_spike").count() == 2


def test_level1_without_times(raw):
    assert traffic.level1_flags(raw.drop("Timestamp")).filter("l1_triggered").count() == 300
    null = raw.withColumn("Timestamp", F.lit(None).cast("timestamp"))
    assert traffic.level1_flags(null).filter("l1_triggered").count() == 300


@pytest.fixture(scope="module")
def packet_rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        flow = 0 if i % 3 == 0 else rng.randrange(1, 12)
        turned = rng.random() < 0.3
        ends = [("10.0.0.1", 1000 + flow), ("10.0.0.2", 80)]
        (a, pa), (b, pb) = reversed(ends) if turned else ends
        data.append((i, float(i), a, pa, b, pb, 6, 60 + i % 50, 40 + i % 50, 40 + i % 50, 64, i % 64, 100, 0, bytes([i % 256] * (10 + i % 60))))
    return spark.createDataFrame(
        data,
        "pkt_no long, ts double, ip_src string, sport int, ip_dst string, dport int, proto int, length int, ip_len int, "
        "ip_declared_len int, ttl int, tcp_flags int, tcp_window int, udp_len int, ip_bytes binary").repartition(5)


def test_header_blocks_both_directions(spark, packet_rows):
    wanted = spark.createDataFrame([(f"10.0.0.1|{1000 + f}|10.0.0.2|80|TCP",) for f in range(6)], "flow_key string")
    got = {r.flow_key: bytes(r.header_bytes) for r in packets.header_blocks(packet_rows, wanted).collect()}
    expected = {}
    for p in sorted(packet_rows.collect(), key=lambda r: r.pkt_no):
        forward = f"{p.ip_src}|{p.sport}|{p.ip_dst}|{p.dport}|TCP"
        back = f"{p.ip_dst}|{p.dport}|{p.ip_src}|{p.sport}|TCP"
        key = forward if forward.startswith("10.0.0.1") else back
        if int(key.split("|")[1]) < 1006:
            expected.setdefault(key, []).append(bytes(p.ip_bytes)[:40].ljust(40, b"\0"))
    assert got == {k: b"".join(v[:24]).ljust(960, b"\0") for k, v in expected.items()}


def test_sequences_are_padded(packet_rows):
    seq = packets.packet_sequences(packet_rows, 16).collect()
    assert all(len(r.sequence) == 16 and len(r.sequence[0]) == 12 for r in seq)
    joined = packets.join_sequences(packet_rows.select(F.lit("none").alias("flow_key")).limit(1), packets.packet_sequences(packet_rows))
    r = joined.first()
    assert not r.found and sum(map(sum, r.sequence)) == 0


def test_packet_channel_joins_once_and_takes_short_sequences(spark, tmp_path):
    """The scores are made from kept rows, not from the table again; short sequences score like padded ones."""
    spark.range(400).selectExpr(
        "id div 4 AS l_orderkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber", "date_add(DATE'2020-01-01', CAST(id % 90 AS INT)) AS l_shipdate",
        "id * 7 AS l_partkey", "id % 10 AS l_suppkey", "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice",
        "CASE WHEN id div 4 % 3 = 0 THEN 'R' ELSE 'A' END AS l_returnflag", "'F' AS l_linestatus",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    scored = catalog.load()[0]["packet_channel"](spark, str(tmp_path))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Exchange" not in plan and "Join" not in plan
    assert scored.count() == 100

    p, f = packet_labelled(spark, str(tmp_path))
    f = f.select("flow_key", "is_attack").unionByName(spark.createDataFrame([("none", 0)], "flow_key string, is_attack int"))
    short = packets.join_sequences(f, packets.packet_sequences(p, padded=False), padded=False)
    padded = packets.join_sequences(f, packets.packet_sequences(p))
    assert {len(r.sequence) for r in short.collect()} == {0, 4} and {len(r.sequence) for r in padded.collect()} == {16}
    ch = models.fit_packets(short, replace(Settings(), fit_iterations=3))
    assert sorted(ch.score(short).select("flow_key", "found", ch.out).collect()) == sorted(
        ch.score(padded).select("flow_key", "found", ch.out).collect()
    )


def test_kept_rows_can_stay_in_their_shuffle_partitions(spark):
    """A fit adds up partition by partition: kept rows are laid out as a cached table has them."""
    few = spark.range(100).groupBy((F.col("id") % 50).alias("k")).count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coalesce = spark.conf.get(COALESCE)
    assert materialize(few, coalesced=False).rdd.getNumPartitions() == parts
    assert spark.conf.get(COALESCE) == coalesce


def test_rank_limit_runs_before_the_shuffle(packet_rows):
    plan = packets.first_packets(packets.with_packet_key(packet_rows), 16)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_upsert_equals_a_loop(spark):
    rng = random.Random(9)
    old = [(i, f"k{rng.randrange(40)}" if i % 7 else "", i) for i in range(100)]
    new = [(i, f"k{rng.randrange(60)}", 1000 + i) for i in range(80)]
    state, order, inserted, updated = {}, [], 0, 0
    for _, k, v in old:
        if k:
            order += [k] if k not in state else []
            state[k] = v
    for _, k, v in new:
        if k in state:
            updated += 1
        else:
            inserted += 1
            order.append(k)
        state[k] = v
    make = lambda d: spark.createDataFrame(d, "seq long, k string, v long").repartition(3)
    merged, counts = governance.upsert(make(old), make(new), "k")
    got = merged.orderBy("position").collect()
    assert [(r.k, r.v) for r in got] == [(k, state[k]) for k in order]
    assert tuple(counts.first()) == (inserted, updated)


def test_incident_join_keeps_alert_rows(spark):
    alerts = spark.createDataFrame([(1, "a", 60.0, "new"), (2, "a", 60.004, "new"), (3, None, 10.0, "new")], "alert_seq long, ip string, threat_score double, status string")
    inc = spark.createDataFrame([("i1", "a", 60.0, "triaged"), ("i2", "a", 60.0, "closed_true"), ("i3", None, 10.0, None)],
                                "incident_id string, ip string, threat_score double, status string")
    one = {r.alert_seq: (r.incident_id, r.status) for r in governance.join_incidents(alerts, inc).collect()}
    assert one == {1: ("i2", "closed_true"), 2: ("i2", "closed_true"), 3: ("i3", "new")}
    assert governance.join_incidents(alerts, inc, all_matches=True).count() == 5


@pytest.mark.parametrize("keep_rows, keep_bytes", [(50, 0), (0, 900), (40, 900), (0, 3), (0, 0)])
def test_retention_equals_a_loop(spark, keep_rows, keep_bytes):
    data = [(i, "x" * (i % 23)) for i in range(120)]
    df = spark.createDataFrame(data, "row_id long, text string").repartition(4)
    size = len("row_id,text") + 1
    kept = []
    for i, t in reversed(data):
        size += len(f"{i},{t}") + 1
        fits = (not keep_rows or len(kept) < keep_rows) and (not keep_bytes or size <= keep_bytes)
        if not fits and kept:
            break
        kept.append(i)
        if not fits:
            break
    for limit in (None, 15):
        marked = retention.mark_tail(df, keep_rows, keep_bytes, limit=limit)
        assert sorted(r.row_id for r in marked.filter("kept").collect()) == sorted(kept)


def test_retention_cut_of_odd_ids(spark):
    """Gaps, negative and repeated ids, rows without one; the plan moves no row."""
    data = [(i, "x" * 9) for i in (-5, 3, 3, 10**12, 10**15, 10**15 + 1)] + [(None, "y")]
    df = spark.createDataFrame(data, "row_id long, text string")
    kept = lambda n: sorted(r.row_id or 0 for r in retention.mark_tail(df, n, 0, limit=4).filter("kept").collect())
    assert kept(3) == [0, 10**15, 10**15 + 1] and kept(1) == [0, 10**15 + 1]
    assert kept(5) == [0, 10**12, 10**15, 10**15 + 1] and kept(6) == [0, 3, 3, 10**12, 10**15, 10**15 + 1] and len(kept(9)) == 7
    assert "Exchange" not in retention.mark_tail(df, 3, 0)._jdf.queryExecution().executedPlan().toString()
    assert retention.mark_tail(df.limit(0), 3, 9).count() == 0
    with pytest.raises(ValueError):
        retention.mark_tail(df, 3, 0, order="text")


def test_slices_do_not_depend_on_partitions(spark, raw):
    attacks = raw.withColumn("source_file", F.when(F.col("row_id") % 2 == 0, "a").otherwise("b"))
    one = sampling.training_slice(raw, attacks, 20, 7)
    two = sampling.training_slice(raw.repartition(9), attacks.repartition(2), 20, 7)
    pick = lambda d: sorted((r.row_id, r.source_file) for r in d.select("row_id", F.coalesce("source_file", F.lit("-")).alias("source_file")).collect())
    assert pick(one) == pick(two) and len(pick(one)) == 34


def test_splits_cover_all_rows(raw):
    train, held = sampling.positional_split(raw, 0.2, ("row_id",), limit=40)
    assert sorted(r.row_id for r in held.collect()) == list(range(240, 300)) and train.count() == 240
    a, b = sampling.stratified_split(raw, "Label")
    assert a.count() + b.count() == 300 and 20 < b.count() < 110


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "t int, g int")
    m = metrics.binary_metrics(df, "t", "g").first()
    assert (m.accuracy, m.f1, m.fpr, m.precision) == (1.0, 0.0, 0.0, 0.0)


def test_progress_interior(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "row_id long, v string")
    state = progress.prefix_digest(df, 7, 1).first()
    import hashlib

    fp = lambda i: hashlib.sha256(f"{i}|v{i}".encode()).hexdigest()
    assert state.head == fp(0) and state.boundary == fp(7)
    watched = progress.watched_ids(df, 7)
    assert len(watched) == 4 and 0 < watched[0] and watched[-1] < 7
    blob = "|".join(fp(i) for i in watched).encode()
    assert state.interior == hashlib.sha256(blob).hexdigest() and state.rows_done == 8


def test_progress_over_ids_with_gaps(spark):
    """Ids as the online buffer writes them: batch * 2**40 + place."""
    ids = [b * 2**40 + n for b in (0, 1) for n in range(1, 101)]
    df = spark.createDataFrame([(i, f"v{i}") for i in ids], "row_id long, v string")
    later = spark.createDataFrame([(2 * 2**40 + 1, "new")], "row_id long, v string")
    state = progress.prefix_digest(df, ids[-1], 0)
    place = progress.start_position(df.unionByName(later), state, 0).first()
    assert place.restart is None and progress.new_rows(df.unionByName(later), place.start).count() == 1
    edited = df.withColumn("v", F.when(F.col("row_id") == ids[-1], "x").otherwise(F.col("v")))
    assert progress.start_position(edited, state, 0).first().restart == "boundary row changed"


def test_isolation_samples_without_rows_times_trees(spark):
    from flowloom.operators import isolation

    small = spark.range(100).withColumnRenamed("id", "row_id").withColumn("x", F.rand(1))
    per_tree = isolation.tree_samples(small, ["x"], "row_id", 20, 64, 1).groupBy("tree").count().collect()
    assert len(per_tree) == 20 and all(20 < r["count"] <= 64 for r in per_tree)
    large = spark.range(60_000).withColumnRenamed("id", "row_id").withColumn("x", F.rand(1))
    drawn = isolation.tree_samples(large, ["x"], "row_id", 20, 64, 1)
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == 20 and min(sizes) > 40 and max(sizes) <= 64


def test_detection_threshold_precedes_suppression(raw):
    scored = raw.withColumns({c: F.lit(0.9) for c in ("l2_rf_attack_score", "l2_emb_attack_score")})
    cfg = Settings(gate_on_level1=False, alert_threshold=0.0, dedup_window_seconds=600)
    all_alerts = detect(scored, Settings(gate_on_level1=False, alert_threshold=0.0))
    assert all_alerts.count() == 300
    kept = detect(scored, cfg, now=BASE)
    split = detect(scored, cfg, now=BASE, group_limit=10)
    assert rows(kept.select("alert_seq")) == rows(split.select("alert_seq")) and kept.count() < 300
    assert detect(scored, Settings(gate_on_level1=False, alert_threshold=101.0)).count() == 0


def test_detection_with_no_model_columns(raw):
    assert detect(raw, Settings()).count() == 0
    assert detect(raw, Settings(), demo=True).count() == 300


def test_isolation_forest_finds_the_outlier(spark, tmp_path):
    rng = random.Random(1)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [(400, 25.0, -25.0)]
    df = spark.createDataFrame(data, "row_id long, a double, b double").repartition(3)
    model = isolation.fit(df, ["a", "b"], trees=40, contamination=0.02)
    flagged = model.flag(df).filter("is_anomaly")
    assert 400 in [r.row_id for r in flagged.collect()] and 4 <= flagged.count() <= 10
    again = isolation.fit(df.repartition(7), ["a", "b"], trees=40, contamination=0.02)
    assert again.threshold == pytest.approx(model.threshold, abs=1e-12)
    model.save(spark, str(tmp_path / "m"))
    loaded = isolation.IsolationForest.load(spark, str(tmp_path / "m"))
    assert rows(loaded.flag(df).select("row_id", "is_anomaly")) == rows(model.flag(df).select("row_id", "is_anomaly"))


def test_channels_beat_the_majority(spark, tmp_path):
    data = [(i, float(i % 10), float(i % 7), int(i % 10 > 6)) for i in range(300)]
    df = spark.createDataFrame(data, "row_id long, a double, b double, is_attack int")
    cfg = Settings(forest_trees=5, forest_depth=4)
    ch = models.fit_forest(df, ["a", "b"], cfg)
    scored = ch.score(df)
    right = scored.filter((F.col(ch.out) >= 0.5).cast("int") == F.col("is_attack")).count()
    assert right > 285 and set(scored.columns) == {*df.columns, ch.out}
    ch.save(str(tmp_path / "rf"))
    loaded = models.Channel.load(spark, str(tmp_path / "rf"))
    assert rows(loaded.score(df)) == rows(scored)
    flagged = df.withColumn("l1_triggered", F.col("row_id") % 2 == 0)
    gated = models.score_channels(flagged, [ch], gate=True)
    assert gated.count() == 300 and gated.filter("not l1_triggered and l2_rf_attack_score <> 0").count() == 0


def test_retrain_accepts_then_waits_for_rows(spark, tmp_path):
    rng = random.Random(2)
    data = [(i, BASE + dt.timedelta(minutes=i), rng.gauss(0, 1) + (9 if i % 40 == 0 else 0), int(i % 40 == 0), i % 3) for i in range(400)]
    df = spark.createDataFrame(data, "row_id long, Timestamp timestamp, a double, is_attack int, `SYN Flag Count` int")
    cfg = Settings(min_retrain_rows=100, forest_trees=3, forest_depth=3, isolation_trees=20, contamination=0.03)
    root = str(tmp_path / "rt")
    first = retrain_once(df, root, ["a"], cfg, deep=False, now=BASE).first()
    assert first.result == "ok" and "isolation_forest=accepted" in first.decisions
    second = retrain_once(df, root, ["a"], cfg, deep=False, now=BASE + dt.timedelta(minutes=1)).first()
    assert (second.result, second.reason) == ("skipped", "nothing new to train on")
    third = retrain_once(df, root, ["a"], Settings(), generation=1, now=BASE + dt.timedelta(minutes=2)).first()
    assert third.reason == "fewer than 5000 new rows"
    assert spark.read.parquet(f"{root}/history").count() == 3
