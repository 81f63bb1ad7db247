"""Line-delimited JSON: exactly one value per line, objects only."""

from pyspark.sql import functions as F, types as T

from flowloom.functions.text import json_kind
from flowloom.sources import lines, proxy

CASES = {
    '{"a": 1}': "object",
    '  {"a": {"b": [1]}}  ': "object",
    '{"a": 1, "a": 2}': "object",
    '{"a": NaN}': "object",
    '{"a": 1}}': None,
    '{"a": 1} x': None,
    '{"a": 1}] x': None,
    '{"a": 1}, {"b": 2}': None,
    "{'a': 1}": None,
    '{"a": ': None,
    "[1, 2, 3]": "other",
    "17": "other",
    '"{text"': "other",
    "null": "other",
    "": None,
    "garbage": None,
}


def test_kinds(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "value string")
    got = {r[0]: r[1] for r in df.select("value", json_kind(F.col("value"))).collect()}
    assert got == CASES


def test_siem_lines_keep_objects(spark):
    values = ['{"ip":"1.1.1.1","event_type":"failed_login"}', "garbage",
              '{"client_ip":"2.2.2.2","evt":"config_change"}', "[1,2,3]",
              '{"ip":"3.3.3.3","event_type":"new_user"}']
    df = lines.parse_objects(spark.createDataFrame([(v,) for v in values], "value string"), lines.SIEM_JSON)
    rows = lines.normalize_siem(df).select("ip", "event_type").collect()
    assert sorted(map(tuple, rows)) == [
        ("1.1.1.1", "failed_login"), ("2.2.2.2", "config_change"), ("3.3.3.3", "new_user")]


def test_missing_source_is_empty(spark, tmp_path):
    assert lines.read_siem_lines(spark, str(tmp_path / "none.ndjson")).count() == 0


def test_row_tables_count_bad_lines(spark):
    schema = T.StructType([T.StructField("id", T.LongType())])
    rows, bad = lines.load_rows(
        spark.createDataFrame([('{"id":1}',), ("{bad",), ("",), ("[2]",)], "value string"), schema)
    assert [r.id for r in rows.collect()] == [1]
    assert bad.first().malformed == 1


def test_proxy_row(spark):
    line = ('{"ts": 1700000000, "client_ip": "10.0.0.9", "host": "ok.local", "port": 443, '
            '"status": 200, "bytes_up": 10, "bytes_down": 5, "duration_ms": 10}')
    marked = proxy.with_outcome(spark.createDataFrame([(line,), ('{"ts": 1}',), ('{"ts":null,"client_ip":null,"host":null,"error":null}',)], "value string"))
    counts = proxy.outcome_counts(marked).first()
    assert (counts.valid_records, counts.missing_required_fields) == (2, 1)
    first, bare = sorted(proxy.to_flows(marked).collect(), key=lambda r: r["RST Flag Count"])
    assert first["Total Fwd Packets"] == 1 and first["Total Backward Packets"] == 0
    assert first["Flow Bytes/s"] == 1500 and first["Flow Packets/s"] == 100
    assert (first["SYN Flag Count"], first["FIN Flag Count"], first["RST Flag Count"]) == (1, 1, 0)
    assert first["http_request_uri"] == "https://ok.local:443/"
    assert str(first["Timestamp"]) == "2023-11-14 22:13:20"
    # a key that is present with null counts as present
    assert bare["RST Flag Count"] == 1 and bare["dns_qname"] == "unknown.local"
    assert bare["Flow Duration"] == 1e-6
