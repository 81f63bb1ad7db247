"""Streams: a failing refresh, replays over several files, growing sources."""

import datetime as dt

from pyspark.sql import functions as F

from flowloom.operators.suppression import suppress
from flowloom.settings import Settings
from flowloom.sources import sinks, tail
from flowloom.streaming import jobs
from flowloom.streaming.suppression import suppress_stream

BASE = dt.datetime(2024, 1, 1)
FLOWS = "row_id long, Timestamp timestamp, `Source IP` string, `SYN Flag Count` long, l2_rf_attack_score double"


def test_refresh_failure_does_not_stop_detection(spark, tmp_path):
    source, out, place = (str(tmp_path / n) for n in ("in", "out", "place"))
    calls = []

    def refresh(batch_id):
        calls.append(batch_id)
        raise RuntimeError("no model")

    cfg = Settings(gate_on_level1=False, alert_threshold=0.0)
    slices = [
        spark.createDataFrame([(i, BASE + dt.timedelta(seconds=i), "1.1.1.1", 0, 0.9)], FLOWS) for i in range(4)
    ]
    jobs.replay(slices, source, lambda: jobs.detect_stream(
        spark, source, FLOWS, out, place, cfg, refresh=refresh, refresh_every=2))
    assert calls == [1, 3]
    assert sorted(r.alert_seq for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    # nothing new: the stream runs again without writing anything twice
    jobs.detect_stream(spark, source, FLOWS, out, place, cfg).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_stream_of_files_equals_the_batch(spark, tmp_path):
    source, out, place = (str(tmp_path / n) for n in ("in", "out", "place"))
    schema = "alert_seq long, ip string, severity string, ts timestamp"
    rows = [(i, f"k{i % 3}", "High", BASE + dt.timedelta(seconds=7 * i % 300)) for i in range(240)]
    df = spark.createDataFrame(rows, schema)
    slices = [df.filter((F.col("alert_seq") >= a) & (F.col("alert_seq") < a + 60)) for a in range(0, 240, 60)]
    jobs.replay(slices, source, lambda: suppress_stream(spark, source, schema, out, place, 20))
    streamed = sorted(r.alert_seq for r in spark.read.parquet(out).collect())
    assert streamed == sorted(r.alert_seq for r in suppress(df, 20).collect())


def test_sync_does_not_repeat_rows(spark, tmp_path):
    source, out, place = (str(tmp_path / n) for n in ("in", "out", "place"))
    line = '{"ts": %d, "client_ip": "10.0.0.1", "host": "h.org", "bytes_up": 600}'
    slices = [spark.createDataFrame([(line % (1_700_000_000 + i + 10 * k),) for i in range(3)] + [("junk",)], "value string") for k in range(3)]
    jobs.replay(slices, source, lambda: jobs.sync_buffer(spark, source, out, place), "text")
    back = spark.read.parquet(out)
    assert back.count() == 9 and back.select("row_id").distinct().count() == 9
    # each batch holds ids above those of the batches before
    bounds = back.groupBy("batch").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b")).orderBy("batch").collect()
    assert all(x.b < y.a for x, y in zip(bounds, bounds[1:]))


def test_stream_scores_with_channels_and_swaps_them(spark, tmp_path):
    """Alerts of the stream equal those of batch scoring with the same saved model."""
    from flowloom.operators import models
    from flowloom.operators.traffic import level1_flags
    from flowloom.plans.detect import detect

    cfg = Settings(gate_on_level1=False, alert_threshold=0.0, forest_trees=5, forest_depth=4)
    rows = [(i, BASE + dt.timedelta(seconds=i), "1.1.1.1", 50 * (i % 2), float(i % 7), i % 2) for i in range(120)]
    schema = "row_id long, Timestamp timestamp, `Source IP` string, `SYN Flag Count` long, `Flow Packets/s` double, is_attack int"
    df = spark.createDataFrame(rows, schema)
    features = ["SYN Flag Count", "Flow Packets/s"]
    models.fit_forest(df, features, cfg).save(str(tmp_path / "model"))
    saved = models.Channel.load(spark, str(tmp_path / "model"))
    source, out, place = (str(tmp_path / n) for n in ("in", "out", "place"))
    flat = spark.createDataFrame([(*r[:3], 0, r[4], r[5]) for r in rows], schema)
    other = models.fit_forest(flat, features, cfg)
    slices = [df.filter("row_id < 60"), df.filter("row_id >= 60")]
    jobs.replay(slices[:1], source, lambda: jobs.detect_stream(
        spark, source, schema, out, place, cfg, channels=[saved], keep_last=10))
    jobs.replay(slices[1:], source, lambda: jobs.detect_stream(
        spark, source, schema, out, place, cfg, channels=[saved], refresh=lambda b: [other], keep_last=10))
    columns = ["alert_seq", "threat_score", "severity"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    scored = [models.score_channels(level1_flags(part), [saved], gate=False) for part in slices]
    expected = sorted(tuple(r) for s in scored for r in detect(s, cfg).select(*columns).collect())
    assert got == expected and 0 < len(got) < 120
    newest = sorted(a for a, *_ in got)[-10:]
    assert sorted(r.alert_seq for r in sinks.read_last(spark, f"{out}-last").collect()) == newest
    jobs.replay([df.filter("row_id < 30").withColumn("row_id", F.col("row_id") + 200), df.filter("row_id < 30").withColumn("row_id", F.col("row_id") + 300)],
                source, lambda: None or jobs.detect_stream(
        spark, source, schema, out, place, cfg, channels=[saved], refresh=lambda b: [other], max_files=1))
    late = {r.alert_seq for r in spark.read.parquet(out).filter("alert_seq >= 200").collect()}
    assert {i for i in late if i < 300} and late <= set(range(200, 230)) | set(range(300, 330))


def _read(reader, start):
    """Offset and values of the next batch."""
    end = reader.latestOffset()
    parts = reader.partitions(start, end)
    batches = [b for p in parts for b in reader.read(p)]
    return end, [(r["generation"], r["value"]) for b in batches for r in b.to_pylist()], len(parts)


def test_tail_reader(tmp_path, monkeypatch):
    """Bounded batches, byte ranges that cut lines, half lines, shorter files, other first lines, no file."""
    monkeypatch.setattr(tail, "SPLIT", 7)
    monkeypatch.setattr(tail, "LOOK", 5)
    path = tmp_path / "a.csv"
    reader = tail.TailReader({"path": str(path), "rows": "4"})
    at = reader.initialOffset()
    assert _read(reader, at) == (at, [], 0)
    path.write_bytes("x,y".encode())
    assert _read(reader, at) == (at, [], 0)
    rows = ["1,é", "", "3,cccccccccccccccccccccc", "4,d", "5,e", "6,f"]
    path.write_text("x,y\n" + "\r\n".join(rows))
    at, values, parts = _read(reader, at)
    assert values == [(0, r) for r in rows[:4]] and at["row"] == 4 and parts > 3
    assert _read(reader, at)[:2] == ({**at, "row": 5, "byte": path.read_bytes().rfind(b"6")}, [(0, "5,e")])
    at = reader.planned
    assert _read(reader, at)[1] == []
    path.write_text("x,y\n" + "\r\n".join(rows) + "6\nx,y\n7,g\n")
    restarted = tail.TailReader({"path": str(path), "rows": "9"})
    restarted.partitions(at, at)  # what the engine says after a restart
    at, values, _ = _read(restarted, at)
    assert values == [(0, "6,f6"), (0, "7,g")]  # a repeated header is no row
    path.write_text("x,y\n8,h\n")
    at, values, _ = _read(restarted, at)
    assert values == [(1, "8,h")] and at["generation"] == 1
    path.write_text("x,z\n8,h\n9,i\n")
    at, values, _ = _read(restarted, at)
    assert values == [(2, "8,h"), (2, "9,i")]
    path.write_text("")
    assert _read(restarted, at)[1] == []


def test_last_rows_are_kept_by_version(spark, tmp_path):
    path = str(tmp_path / "last")
    part = lambda ids: spark.createDataFrame([(i,) for i in ids], "alert_seq long")
    for version, ids in enumerate([[1, 2, 3], [7, 8], [4, 9], [4, 9]]):
        sinks.keep_last(part(ids), path, min(version, 2), 4, ["-alert_seq"])  # the last one runs twice
    assert sorted(r.alert_seq for r in sinks.read_last(spark, path).collect()) == [4, 7, 8, 9]
    assert sinks._versions(spark, path) == [1, 2]


def test_batches_that_come_together_are_the_same(tmp_path, monkeypatch):
    """Lines are numbered by their batch of ``rows``, however many batches a micro-batch takes."""
    monkeypatch.setattr(tail, "SPLIT", 7)
    monkeypatch.setattr(tail, "LOOK", 5)
    path = tmp_path / "a.csv"
    path.write_text("x\n" + "".join(f"{i % 13 * 'a'}{i}\n" for i in range(50)) + "half")

    def numbered(together):
        reader = tail.TailReader({"path": str(path), "rows": "3", "together": str(together)})
        at, out, turns = reader.initialOffset(), [], 0
        while (end := reader.latestOffset()) != at:
            out += [tuple(r.values()) for p in reader.partitions(at, end) for b in reader.read(p) for r in b.to_pylist()]
            at, turns = end, turns + 1
        return out, turns, at["batch"]

    one, many = numbered(1), numbered(4)
    assert one[0] == many[0] and one[2] == many[2] == 17
    assert one[1] == 17 and many[1] == 5  # before, every batch was a micro-batch
    assert [b for _, _, b, _ in one[0]] == [i // 3 for i in range(50)]


def test_a_tail_that_fell_behind_catches_up(spark, tmp_path):
    """The numbers go on over a second run; a few micro-batches hold many batches."""
    path, out, place = (str(tmp_path / n) for n in ("a.csv", "out", "place"))
    lines = [f"{i},u{i}\n" for i in range(1000)]
    for held in ("".join(lines)[:-3], "".join(lines)):
        with open(path, "w") as f:
            f.write("row_id,ip\n" + held)
        jobs.follow(jobs.tail_stream(spark, path, "row_id long, ip string", out, place, 4))
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("row_id", "batch").collect())
    assert got == [(i, i // 4 if i < 999 else 250) for i in range(1000)]
    assert len(list((tmp_path / "out").glob("run=*"))) == 2
