"""Cleaning, typing and feature queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from flowloom.catalog.base import FLOWS, FLOWS_URI, flows, query, table
from flowloom.functions import cleaning, network, text
from flowloom.operators import features, schema
from flowloom.settings import Settings

DIRTY_NUMBER = (
    "CASE event_id % 7 WHEN 0 THEN ' 12.5 ' WHEN 1 THEN 'abc' WHEN 2 THEN NULL "
    "WHEN 3 THEN '2d' WHEN 4 THEN 'NaN' WHEN 5 THEN concat('-', CAST(event_id AS {s})) "
    "ELSE '1e3' END"
)


@query(
    "parse_timestamps",
    r"""
WITH d AS (SELECT event_id, CASE event_id % 8
    WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
    WHEN 2 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') WHEN 3 THEN strftime(ts, '%d/%m/%Y %H:%M')
    WHEN 4 THEN strftime(ts, '  %Y-%m-%dT%H:%M:%S') WHEN 5 THEN 'none'
    WHEN 6 THEN 'not a time' ELSE ' ' END AS t FROM events)
SELECT event_id AS row_id, epoch_us(coalesce(
    try_strptime(trim(t), ['%Y-%m-%d %H:%M:%S', '%Y/%m/%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S']),
    try_strptime(trim(t), ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M']))) AS micros FROM d""",
)
def parse_timestamps(spark, sf):
    """Both date styles, blanks and junk, each row parsed on its own."""
    e = table(spark, sf, "events")
    styles = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")
    kind = F.col("event_id") % 8
    dirty = F.when(kind == 4, F.concat(F.lit("  "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    for i, style in enumerate(styles):
        dirty = dirty.when(kind == i, F.date_format("ts", style))
    dirty = dirty.when(kind == 5, F.lit("none")).when(kind == 6, F.lit("not a time"))
    return e.select(
        F.col("event_id").alias("row_id"),
        cleaning.micros(cleaning.parse_timestamp(dirty.otherwise(F.lit(" ")))).alias("micros"),
    )


@query(
    "fill_missing_columns",
    """
SELECT event_id AS row_id, 'BENIGN' AS label, 0.0::DOUBLE AS duration, value AS pps,
  'TCP' AS protocol, 0 AS port, 0 AS source_port, '0.0.0.0' AS qname,
  epoch_us(TIMESTAMP '2024-01-01 00:00:00') + event_id * 1000 AS micros FROM events""",
)
def fill_missing_columns(spark, sf):
    """Defaults for every absent column, a synthetic time series included."""
    raw = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.col("value").alias("Flow Packets/s")
    )
    full = schema.complete_schema(raw, base_time=dt.datetime(2024, 1, 1))
    return full.select(
        "row_id",
        F.col("Label").alias("label"),
        F.col("Flow Duration").alias("duration"),
        F.col("Flow Packets/s").alias("pps"),
        F.col("Protocol").alias("protocol"),
        F.col("Destination Port").alias("port"),
        F.col("Source Port").alias("source_port"),
        F.col("dns_qname").alias("qname"),
        cleaning.micros(F.col("Timestamp")).alias("micros"),
    )


@query(
    "synthetic_timestamps",
    """
SELECT event_id AS row_id, epoch_us(TIMESTAMP '2024-06-01 12:00:00') + event_id * 1000 AS micros
FROM events""",
)
def synthetic_timestamps(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_id").alias("row_id"))
    full = schema.complete_schema(raw, base_time=dt.datetime(2024, 6, 1, 12))
    return full.select("row_id", cleaning.micros(F.col("Timestamp")).alias("micros"))


@query(
    "coerce_numbers",
    f"""
WITH d AS (SELECT event_id, {DIRTY_NUMBER.format(s='VARCHAR')} AS t FROM events)
SELECT event_id AS row_id, CASE WHEN trim(t) = 'NaN' THEN 0.0
  ELSE coalesce(try_cast(trim(t) AS DOUBLE), 0.0) END AS number FROM d""",
)
def coerce_numbers(spark, sf):
    d = table(spark, sf, "events").selectExpr(
        "event_id AS row_id", f"{DIRTY_NUMBER.format(s='STRING')} AS t"
    )
    return d.select("row_id", cleaning.number_or_zero(F.col("t")).alias("number"))


@query(
    "attack_flags_and_classes",
    """
SELECT event_id AS row_id, (upper(l) <> 'BENIGN')::INT AS is_attack,
  CASE WHEN upper(trim(l)) <> 'BENIGN' THEN 'ATTACK' ELSE 'BENIGN' END AS class_from_label,
  CASE WHEN upper(l) <> 'BENIGN' THEN 'ATTACK' ELSE 'BENIGN' END AS class_from_flag
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'PortScan' WHEN 'view' THEN 'benign'
  WHEN 'click' THEN ' BENIGN' ELSE 'BENIGN' END AS l FROM events)""",
)
def attack_flags_and_classes(spark, sf):
    """The 0/1 flag (blanks count) and the binary class (blanks trimmed)."""
    kind = F.col("event_type")
    label = (
        F.when(kind == "error", "PortScan")
        .when(kind == "view", "benign")
        .when(kind == "click", " BENIGN")
        .otherwise("BENIGN")
    )
    d = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), label.alias("l"))
    d = d.withColumn("is_attack", cleaning.is_attack(F.col("l")))
    return d.select(
        "row_id",
        "is_attack",
        cleaning.attack_class(None, F.col("l")).alias("class_from_label"),
        cleaning.attack_class(F.col("is_attack")).alias("class_from_flag"),
    )


@query(
    "protocol_tokens",
    """
SELECT event_id AS row_id, CASE event_id % 7 WHEN 0 THEN 'TCP' WHEN 1 THEN 'TCP' WHEN 2 THEN 'UDP'
  WHEN 3 THEN 'ICMP' WHEN 4 THEN 'P47' WHEN 5 THEN 'TCP' ELSE 'SCTP' END AS token FROM events""",
)
def protocol_tokens(spark, sf):
    kinds = F.array(*[F.lit(v) for v in ("6", "6.0", "17", "1", "47", " tcp ", "sctp")])
    e = table(spark, sf, "events")
    proto = F.get(kinds, (F.col("event_id") % 7).cast("int"))
    return e.select(
        F.col("event_id").alias("row_id"), network.protocol_token(proto).alias("token")
    )


@query(
    "flow_keys",
    f"""
WITH {FLOWS}
SELECT row_id, concat("Source IP", '|', "Source Port", '|', "Destination IP", '|',
  "Destination Port", '|', CASE "Protocol" WHEN 17 THEN 'UDP' ELSE 'TCP' END) AS flow_key
FROM flows""",
)
def flow_keys(spark, sf):
    return features.with_flow_key(flows(spark, sf)).select("row_id", "flow_key")


@query(
    "header_copies",
    f"""
WITH {FLOWS}
SELECT row_id, "Flow Duration"::DOUBLE AS "hdr_Flow_Duration",
  "Fwd Packet Length Max"::DOUBLE AS "hdr_Fwd_Packet_Length_Max",
  "Bwd Packet Length Max"::DOUBLE AS "hdr_Bwd_Packet_Length_Max",
  "Flow Bytes/s"::DOUBLE AS "hdr_Flow_Bytes/s", "Flow Packets/s"::DOUBLE AS "hdr_Flow_Packets/s",
  "SYN Flag Count"::DOUBLE AS "hdr_SYN_Flag_Count",
  ((('0x' || substr(md5(concat_ws('|', "Protocol", "Destination Port", "Source IP",
    "SYN Flag Count", "FIN Flag Count", "RST Flag Count")), 1, 8))::BIGINT) % 512)::DOUBLE
    AS hdr_flow_fingerprint,
  0.0::DOUBLE AS hdr_ip_ttl_mean, 0.0::DOUBLE AS hdr_tcp_window_max
FROM flows""",
)
def header_copies(spark, sf):
    """Header feature block: numeric copies, fingerprint bucket, aliases."""
    df = features.enrich_headers(flows(spark, sf))
    return df.select("row_id", *[c for c in df.columns if c.startswith("hdr_")])


@query(
    "utc_timestamps",
    """
SELECT event_id AS row_id, epoch_us(ts) AS utc_micros,
  epoch_us(ts) - 3600000000 AS from_zone_micros FROM events""",
)
def utc_timestamps(spark, sf):
    """Wall-clock times read as UTC, and as a zone one hour ahead of it."""
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        cleaning.micros(cleaning.to_utc(ts)).alias("utc_micros"),
        cleaning.micros(cleaning.to_utc(ts, "+01:00")).alias("from_zone_micros"),
    )


@query(
    "prepared_table",
    f"""
WITH {FLOWS_URI}, n AS (SELECT *, count(http_request_uri) OVER (PARTITION BY "Source IP",
    date_trunc('minute', "Timestamp")) AS same,
  stddev_samp(length(http_request_uri)) OVER (PARTITION BY "Source IP" ORDER BY "Timestamp", row_id
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sd FROM flows)
SELECT row_id, epoch_us("Timestamp") AS micros, "Flow Duration"::DOUBLE AS duration,
  "Flow Packets/s"::DOUBLE AS pps, length(http_request_uri)::DOUBLE AS http_token_len,
  same::DOUBLE AS http_flows_same_ip_60s, round(coalesce(sd, 0), 6) AS http_uri_len_roll_std,
  ((('0x' || substr(md5(http_method), 1, 8))::BIGINT) % 997)::DOUBLE AS http_method_hash,
  length(dns_qname)::DOUBLE AS dns_qname_len, 0.0::DOUBLE AS pcap_plaintext_hits,
  "Source IP" AS ip, ("Label" <> 'BENIGN')::INT AS is_attack FROM n""",
)
def prepared_table(spark, sf):
    """The whole prepare job: complete, enrich, key, select, label."""
    from flowloom.plans.prepare import prepare

    p = prepare(flows(spark, sf, uri=True))
    return p.select(
        "row_id",
        cleaning.micros(F.col("Timestamp")).alias("micros"),
        F.col("Flow Duration").alias("duration"),
        F.col("Flow Packets/s").alias("pps"),
        "http_token_len",
        "http_flows_same_ip_60s",
        F.round("http_uri_len_roll_std", 6).alias("http_uri_len_roll_std"),
        "http_method_hash",
        "dns_qname_len",
        "pcap_plaintext_hits",
        F.col("Source IP").alias("ip"),
        "is_attack",
    )


@query(
    "required_columns",
    """
SELECT 'error' AS level, 'missing column Label' AS message
UNION ALL SELECT 'error', 'missing column Source IP'
UNION ALL SELECT 'error', 'missing column Destination IP'
UNION ALL SELECT 'error', 'table has no rows' WHERE (SELECT count(*) FROM events) = 0
UNION ALL SELECT 'warning', 'missing column Protocol'
UNION ALL SELECT 'warning', 'missing column Destination Port'""",
)
def required_columns(spark, sf):
    """Findings of the corporate check on a table that lacks most columns."""
    raw = table(spark, sf, "events").withColumnRenamed("ts", "Timestamp")
    return schema.column_report(raw, schema.check_corporate(raw))


@query(
    "prepared_invariants",
    """
SELECT count(*) AS rows, count(*) FILTER (WHERE l_returnflag = 'R') AS label_mismatches,
  0::BIGINT AS bad_header_widths, false AS header_all_zero FROM lineitem""",
)
def prepared_invariants(spark, sf):
    """Labels against a flag that is wrong for some rows; header block checks."""
    label = F.when(F.col("l_returnflag").isin("A", "R"), "DoS").otherwise("BENIGN")
    block = F.rpad(F.unhex(F.md5(F.col("l_orderkey").cast("string"))), F.lit(960), F.unhex(F.lit("00")))
    d = table(spark, sf, "lineitem").select(
        label.alias("Label"),
        (F.col("l_returnflag") == "A").cast("int").alias("is_attack"),
        block.alias("header_bytes"),
    )
    return schema.prepared_invariants(d)


@query(
    "rows_with_time",
    "SELECT count(*) AS kept FROM events WHERE event_type <> 'view'",
)
def rows_with_time(spark, sf):
    """Rows without an event time are dropped before bucketing."""
    t = table(spark, sf, "events").select(F.when(F.col("event_type") != "view", F.col("ts")).alias("ts"))
    return t.dropna(subset=["ts"]).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "benign_and_attack_rows",
    f"""
WITH {FLOWS}
SELECT "Label" <> 'BENIGN' AS attack, count(*) AS flows, sum("Total Fwd Packets")::BIGINT AS packets
FROM flows GROUP BY 1""",
)
def benign_and_attack_rows(spark, sf):
    benign, attack = schema.split_by_class(flows(spark, sf))
    both = benign.withColumn("attack", F.lit(False)).unionByName(
        attack.withColumn("attack", F.lit(True))
    )
    return both.groupBy("attack").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("Total Fwd Packets").alias("packets")
    )


@query(
    "uri_features",
    """
SELECT page_id, length(url)::DOUBLE AS http_token_len,
  (length(url) - length(replace(url, '/', '')))::DOUBLE AS http_slash_count,
  round((length(url) - length(regexp_replace(url, '[^a-zA-Z0-9]', '', 'g')))::DOUBLE
    / greatest(length(url), 1), 9) AS http_non_alnum_ratio FROM pages""",
)
def uri_features(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        text.uri_length(u).alias("http_token_len"),
        text.uri_slashes(u).alias("http_slash_count"),
        F.round(text.uri_non_alnum_ratio(u), 9).alias("http_non_alnum_ratio"),
    )


@query(
    "method_and_fingerprint_buckets",
    f"""
WITH {FLOWS}
SELECT row_id, ((('0x' || substr(md5(http_method), 1, 8))::BIGINT) % 997)::DOUBLE AS method_bucket,
  ((('0x' || substr(md5(concat("Protocol", '|', "Destination Port", '|', "Source IP")), 1, 8))::BIGINT)
    % 512)::DOUBLE AS fingerprint FROM flows""",
)
def method_and_fingerprint_buckets(spark, sf):
    parts = [cleaning.name(c) for c in ("Protocol", "Destination Port", "Source IP")]
    return flows(spark, sf).select(
        "row_id",
        text.method_bucket(F.col("http_method")).alias("method_bucket"),
        text.fingerprint_bucket(parts).alias("fingerprint"),
    )


_QNAME = "CASE page_id % 4 WHEN 0 THEN concat(q, '..') WHEN 1 THEN concat(' ', q) WHEN 2 THEN '' ELSE q END"


@query(
    "dns_name_features",
    f"""
WITH b AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?]+)', 1) AS q FROM pages),
d AS (SELECT page_id, {_QNAME} AS q FROM b),
e AS (SELECT page_id, q, regexp_replace(trim(q), '\\.+$', '') AS s FROM d)
SELECT page_id, length(q)::DOUBLE AS dns_qname_len,
  len(list_filter(string_split(s, '.'), lambda p: p <> ''))::DOUBLE AS dns_label_count,
  coalesce(list_max(list_transform(string_split(s, '.'), lambda p: length(p))), 0)::DOUBLE
    AS dns_max_label_len,
  round(length(regexp_replace(s, '[^0-9]', '', 'g'))::DOUBLE / greatest(length(s), 1), 9)
    AS dns_digit_ratio FROM e""",
)
def dns_name_features(spark, sf):
    q = F.regexp_extract("url", "^[a-z]+://([^/:?]+)", 1)
    d = table(spark, sf, "pages").withColumn("q", q).selectExpr("page_id", f"{_QNAME} AS q")
    n = F.col("q")
    return d.select(
        "page_id",
        text.dns_length(n).alias("dns_qname_len"),
        text.dns_label_count(n).alias("dns_label_count"),
        text.dns_longest_label(n).alias("dns_max_label_len"),
        F.round(text.dns_digit_ratio(n), 9).alias("dns_digit_ratio"),
    )


_ENTROPY = """round(coalesce(list_sum(list_transform(list_distinct({items}),
  lambda ch: -({count} / {total}) * log2({count} / {total} {smooth}))), 0), 6)"""


@query(
    "character_entropy",
    "SELECT 'p' || page_id AS id, "
    + _ENTROPY.format(
        items="string_split(url, '')",
        count="(length(url) - length(replace(url, ch, '')))::DOUBLE",
        total="length(url)",
        smooth="",
    )
    + " AS entropy FROM pages UNION ALL SELECT 'd' || doc_id, "
    + _ENTROPY.format(
        items="string_split(text, '')",
        count="(length(text) - length(replace(text, ch, '')))::DOUBLE",
        total="length(text)",
        smooth="",
    )
    + " FROM documents",
)
def character_entropy(spark, sf):
    """Entropy of addresses and of whole documents."""
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("url").alias("t")
    )
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("t")
    )
    return pages.unionByName(docs).select(
        "id", F.round(text.entropy(F.col("t")), 6).alias("entropy")
    )


@query(
    "time_bucket_floor",
    """
SELECT event_id AS row_id, epoch_us(ts) - epoch_us(ts) % 60000000 AS minute,
  epoch_us(ts) - epoch_us(ts) % 420000000 AS seven_minutes FROM events""",
)
def time_bucket_floor(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        cleaning.bucket_micros(ts, 60).alias("minute"),
        cleaning.bucket_micros(ts, 420).alias("seven_minutes"),
    )


@query(
    "same_ip_minute_counts",
    f"""
WITH {FLOWS_URI}, t AS (SELECT *, CASE WHEN event_type <> 'view' THEN "Timestamp" END AS t,
  CASE WHEN event_type <> 'click' THEN http_request_uri END AS u FROM flows)
SELECT row_id, (count(u) OVER (PARTITION BY "Source IP", date_trunc('minute', t)))::DOUBLE AS n
FROM t""",
)
def same_ip_minute_counts(spark, sf):
    """URI counts per source and minute; rows without a time share a group."""
    d = flows(spark, sf, uri=True).withColumns(
        {
            "Timestamp": F.when(F.col("event_type") != "view", F.col("Timestamp")),
            "http_request_uri": F.when(F.col("event_type") != "click", F.col("http_request_uri")),
        }
    )
    return features.same_ip_minute_count(d, "http_request_uri", "n").select("row_id", "n")


@query(
    "rolling_uri_deviation",
    f"""
WITH {FLOWS_URI}, t AS (SELECT *, CASE WHEN event_type <> 'view' THEN "Timestamp" END AS t FROM flows)
SELECT row_id, round(coalesce(stddev_samp(length(http_request_uri)) OVER (PARTITION BY "Source IP"
  ORDER BY t NULLS LAST, row_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0), 6) AS sd FROM t""",
)
def rolling_uri_deviation(spark, sf):
    d = flows(spark, sf, uri=True).withColumns(
        {
            "Timestamp": F.when(F.col("event_type") != "view", F.col("Timestamp")),
            "len": F.length("http_request_uri").cast("double"),
        }
    )
    rolled = features.rolling_uri_std(d.select("row_id", "Source IP", "Timestamp", "len"), "len", "sd")
    return rolled.select("row_id", F.round("sd", 6).alias("sd"))


@query(
    "prepared_layout",
    """
SELECT column_position, column_name FROM (VALUES """
    + ", ".join(
        f"({i}, '{c}')"
        for i, c in enumerate(
            [
                "row_id",
                "Timestamp",
                *Settings().numeric_features,
                "Protocol",
                "Destination Port",
                "Source IP",
                "Source Port",
                "http_request_uri",
                "dns_qname",
                "Destination IP",
                "flow_key",
                "Label",
                "is_attack",
            ]
        )
    )
    + ") AS t(column_position, column_name) WHERE (SELECT count(*) FROM events) > 0",
)
def prepared_layout(spark, sf):
    """Order of the prepared columns, read off the prepared table itself."""
    from flowloom.plans.prepare import prepare

    p = prepare(flows(spark, sf, uri=True))
    named = F.posexplode(F.array(*[F.lit(c) for c in p.columns]))
    return p.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        named.alias("column_position", "column_name")
    )
