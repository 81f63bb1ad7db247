"""SIEM and proxy-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.catalog.base import FLOW_COLUMNS, SIEM, duck_text, query, siem, spark_text, table
from flowloom.functions import network, text
from flowloom.functions.cleaning import micros
from flowloom.operators.correlation import siem_counts
from flowloom.session import scratch_path, spread_small
from flowloom.sources import lines, proxy

IP = FLOW_COLUMNS["Source IP"]


def siem_lines(spark, sf) -> DataFrame:
    """SIEM events as text lines: two spellings, junk, arrays and blanks."""
    e = table(spark, sf, "events").withColumn("ip", F.expr(spark_text(IP)))
    kind = F.col("event_id") % 10
    t = F.concat(F.lit("t_"), F.col("event_type"))
    alias = F.to_json(F.struct(F.col("ip").alias("client_ip"), t.alias("evt")))
    plain = F.to_json(F.struct("ip", t.alias("event_type"), F.lit("low").alias("severity")))
    line = (
        F.when(kind == 0, F.lit("{not json"))
        .when(kind == 1, F.concat(F.lit("["), plain, F.lit("]")))
        .when(kind == 2, F.lit("  "))
        .when(kind == 3, F.lit("17"))
        .when(kind == 4, F.concat(F.lit("  "), alias))
        .otherwise(plain)
    )
    return e.select(line.alias("value"))


_SIEM_EXPECTED = f"""
SELECT {duck_text(IP)} AS ip, concat('t_', event_type) AS event_type,
  CASE WHEN event_id % 10 > 4 THEN 'low' END AS severity, count(*) AS n
FROM events WHERE event_id % 10 >= 4 GROUP BY ALL"""


@query("siem_events_from_lines", _SIEM_EXPECTED)
def siem_events_from_lines(spark, sf):
    """NDJSON written and read back; bad and non-object lines are left out."""
    path = scratch_path(spark, "siem-lines")
    siem_lines(spark, sf).write.text(path)
    events = lines.read_siem_lines(spark, path)
    return events.groupBy("ip", "event_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "siem_events_from_array",
    f"""SELECT {duck_text(IP)} AS ip, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def siem_events_from_array(spark, sf):
    """JSON arrays (one per file, several lines each) of SIEM events."""
    e = table(spark, sf, "events").withColumn("ip", F.expr(spark_text(IP)))
    one = F.to_json(F.struct(F.col("ip").alias("src_ip"), F.col("event_type").alias("type")))
    arrays = e.groupBy(F.floor(F.col("event_id") / 5000).alias("part")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list(one), ",\n"), F.lit("\n]")).alias("value")
    )
    path = scratch_path(spark, "siem-array")
    arrays.write.partitionBy("part").text(path)
    events = lines.read_siem_array(spark, path)
    return events.groupBy("ip", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "siem_field_aliases",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {duck_text(IP)} ELSE concat('c', user_id) END AS ip,
  CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'other' END AS any_type FROM events""",
)
def siem_field_aliases(spark, sf):
    """First alias of the table against first alias set in each row."""
    e = table(spark, sf, "events")
    raw = e.select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.expr(spark_text(IP))).alias("ip"),
        F.concat(F.lit("c"), F.col("user_id")).alias("client_ip"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("evt"),
        F.lit("other").alias("type"),
    )
    table_wide = lines.first_present(raw, "event_type", lines.TYPE_ALIASES)
    return raw.select(
        "event_id",
        lines.first_present(raw, "ip", lines.IP_ALIASES).alias("ip"),
        table_wide.alias("event_type"),
        F.coalesce("evt", "type").alias("any_type"),
    )


@query(
    "siem_counts",
    f"""WITH {SIEM}
SELECT ip, count(*) FILTER (WHERE event_type = 'failed_login') AS failed_login,
  count(*) FILTER (WHERE event_type = 'config_change') AS config_change,
  count(*) FILTER (WHERE event_type = 'new_user') AS new_user FROM siem GROUP BY ip""",
)
def siem_counts_query(spark, sf):
    return siem_counts(siem(spark, sf))


@query(
    "json_fields",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'object' END AS kind FROM events""",
)
def json_fields(spark, sf):
    """A field by path, and null kind for broken text."""
    e = table(spark, sf, "events")
    broken = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return e.select(
        "event_id",
        text.json_field(F.col("props"), "k", "bigint").alias("k"),
        text.json_kind(broken).alias("kind"),
    )


def proxy_lines(spark, sf) -> DataFrame:
    """Proxy records as text lines, one in ten broken in some way."""
    i = F.col("event_id")
    record = F.struct(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts"),
        F.when(i % 10 != 3, F.expr(spark_text(IP))).alias("client_ip"),
        F.when(i % 3 == 0, "GET").when(i % 3 == 1, "connect").alias("method"),
        F.concat(F.lit("h"), F.col("user_id"), F.when(i % 2 == 0, ".org").otherwise("")).alias("host"),
        F.when(i % 4 != 0, (i % 60000).cast("int")).alias("port"),
        F.when(i % 5 == 0, F.concat(F.lit("/p"), i)).when(i % 5 == 1, "q").alias("path"),
        F.when(i % 2 == 0, "http").alias("scheme"),
        F.when(i % 6 != 0, F.when(i % 3 == 0, 200).otherwise(404)).alias("status"),
        (i * 37 % 5000).alias("bytes_up"),
        (i * 91 % 90000).alias("bytes_down"),
        (i % 300).cast("double").alias("duration_ms"),
        F.when(i % 11 == 0, "timeout").alias("error"),
    )
    line = (
        F.when(i % 10 == 0, F.lit("{broken"))
        .when(i % 10 == 1, F.lit("[1, 2, 3]"))
        .when(i % 10 == 2, F.lit(" "))
        .otherwise(F.to_json(record))
    )
    events = spread_small(table(spark, sf, "events"))
    return events.select(F.col("event_id").alias("row_id"), line.alias("value"))


@query(
    "proxy_line_outcomes",
    """SELECT count(*) AS processed_lines, count(*) FILTER (WHERE event_id % 10 > 3) AS valid_records,
  count(*) FILTER (WHERE event_id % 10 = 2) AS empty_lines,
  count(*) FILTER (WHERE event_id % 10 = 0) AS invalid_json,
  count(*) FILTER (WHERE event_id % 10 = 1) AS invalid_type,
  count(*) FILTER (WHERE event_id % 10 = 3) AS missing_required_fields FROM events""",
)
def proxy_line_outcomes(spark, sf):
    return proxy.outcome_counts(proxy.with_outcome(proxy_lines(spark, sf)))


@query(
    "proxy_quarantine",
    """SELECT event_id AS row_id, CASE event_id % 10 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'invalid_type'
  WHEN 2 THEN 'empty_lines' ELSE 'missing_required_fields' END AS outcome
FROM events WHERE event_id % 10 <= 3""",
)
def proxy_quarantine(spark, sf):
    marked = proxy.with_outcome(proxy_lines(spark, sf))
    return proxy.quarantine(marked).select("row_id", "outcome")


PROXY_SQL = f"""x AS (SELECT event_id AS i, epoch_us(ts) // 1000000 * 1000000 AS micros, {duck_text(IP)} AS ip,
  CASE event_id % 3 WHEN 0 THEN 'GET' ELSE 'CONNECT' END AS method,
  concat('h', user_id, CASE WHEN event_id % 2 = 0 THEN '.org' ELSE '' END) AS host,
  CASE WHEN event_id % 4 = 0 OR event_id % 60000 = 0 THEN 443 ELSE event_id % 60000 END AS port,
  CASE event_id % 5 WHEN 0 THEN concat('/p', event_id) WHEN 1 THEN '/q' ELSE '/' END AS path,
  CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'https' END AS scheme,
  event_id * 37 % 5000 AS up, event_id * 91 % 90000 AS down,
  greatest((event_id % 300) / 1000.0::DOUBLE, 1e-6) AS sec FROM events WHERE event_id % 10 > 3),
y AS (SELECT *, greatest(up // 512, 1) AS fwd, down // 512 AS bwd FROM x),
proxied AS (SELECT i AS row_id, micros, ip, round(sec, 6) AS duration, fwd, bwd,
  least(1500, greatest(up, 64)) AS fwd_max, least(100, up // fwd) AS fwd_min,
  round(up::DOUBLE / fwd, 6) AS fwd_mean, least(1500, down) AS bwd_max,
  round(least((up + down)::DOUBLE / sec, 1e9), 3) AS bytes_s, round(least((fwd + bwd)::DOUBLE / sec, 1e6), 3) AS packets_s,
  (method = 'CONNECT')::INT AS syn, (i % 6 <> 0 AND i % 3 = 0)::INT AS fin, (i % 11 = 0)::INT AS rst,
  port::INT AS port, concat(scheme, '://', host, ':', port, path) AS uri,
  CASE WHEN contains(host, '.') THEN host ELSE concat(host, '.local') END AS qname FROM y)"""


def proxied(df: DataFrame) -> DataFrame:
    return df.select(
        "row_id",
        micros(F.col("Timestamp")).alias("micros"),
        F.col("Source IP").alias("ip"),
        F.col("Flow Duration").alias("duration"),
        F.col("Total Fwd Packets").alias("fwd"),
        F.col("Total Backward Packets").alias("bwd"),
        F.col("Fwd Packet Length Max").alias("fwd_max"),
        F.col("Fwd Packet Length Min").alias("fwd_min"),
        F.round("Fwd Packet Length Mean", 6).alias("fwd_mean"),
        F.col("Bwd Packet Length Max").alias("bwd_max"),
        F.round("Flow Bytes/s", 3).alias("bytes_s"),
        F.round("Flow Packets/s", 3).alias("packets_s"),
        F.col("SYN Flag Count").alias("syn"),
        F.col("FIN Flag Count").alias("fin"),
        F.col("RST Flag Count").alias("rst"),
        F.col("Destination Port").alias("port"),
        F.col("http_request_uri").alias("uri"),
        F.col("dns_qname").alias("qname"),
    )


@query("proxy_flows", f"WITH {PROXY_SQL} SELECT * FROM proxied")
def proxy_flows(spark, sf):
    """Valid proxy lines as flow rows."""
    return proxied(proxy.to_flows(proxy.with_outcome(proxy_lines(spark, sf))))


@query(
    "routable_addresses",
    """WITH a AS (SELECT event_id, concat(event_id * 7 % 256, '.', event_id % 260, '.', user_id, '.',
  event_id * 3 % 256) AS ip FROM events),
n AS (SELECT event_id, ip, list_transform(string_split(ip, '.'), lambda p: p::BIGINT) AS o FROM a),
v AS (SELECT *, o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] AS x, o[2] <= 255 AND o[3] <= 255 AS ok FROM n)
SELECT event_id, ip, ok AND NOT (o[1] IN (0, 10, 127) OR o[1] >= 240 OR (o[1] = 169 AND o[2] = 254)
  OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168)
  OR x BETWEEN 3221225472 AND 3221225479 OR x BETWEEN 3221225642 AND 3221225643
  OR (o[1] = 192 AND o[2] = 0 AND o[3] = 2) OR (o[1] = 198 AND o[2] IN (18, 19))
  OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)) AS routable FROM v""",
)
def routable_addresses(spark, sf):
    """Addresses of all kinds, some with an octet above 255."""
    i = F.col("event_id")
    ip = F.concat_ws(".", i * 7 % 256, i % 260, F.col("user_id"), i * 3 % 256)
    return table(spark, sf, "events").select(
        "event_id", ip.alias("ip"), network.is_routable(ip).alias("routable")
    )
