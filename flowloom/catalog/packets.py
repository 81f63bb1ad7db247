"""Packet and flow-slice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.base import FLOWS, PACKETS, flows, packets, query, table
from flowloom.functions import scoring, text
from flowloom.operators import packets as ops
from flowloom.operators import sampling
from flowloom.operators.features import with_flow_key

# Flow keys of two thirds of the orders, every third of them turned around.
WANTED = """wanted AS (SELECT DISTINCT CASE WHEN l_orderkey % 5 = 0
  THEN concat(ip_dst, '|', dport, '|', ip_src, '|', sport, '|', p) ELSE flow_key END AS flow_key
  FROM (SELECT *, string_split(flow_key, '|')[5] AS p FROM keyed) WHERE l_orderkey % 3 <> 0)"""
# Ports are 0 outside TCP and UDP.
KEYED = """keyed AS (SELECT * REPLACE (CASE WHEN proto IN (6, 17) THEN sport ELSE 0 END AS sport,
  CASE WHEN proto IN (6, 17) THEN dport ELSE 0 END AS dport,
  concat(ip_src, '|', CASE WHEN proto IN (6, 17) THEN sport ELSE 0 END, '|', ip_dst, '|',
    CASE WHEN proto IN (6, 17) THEN dport ELSE 0 END, '|', string_split(flow_key, '|')[5]) AS flow_key)
  FROM packets)"""
VIEWS = f"{PACKETS}, {KEYED}"


def wanted_keys(spark, sf):
    keyed = ops.with_packet_key(packets(spark, sf))
    turned = F.when(
        F.col("l_orderkey") % 5 == 0, ops.reverse_flow_key(F.col("flow_key"))
    ).otherwise(F.col("flow_key"))
    return keyed.filter(F.col("l_orderkey") % 3 != 0).select(turned.alias("flow_key")).distinct()


@query(
    "packet_flows",
    f"""WITH {VIEWS}, g AS (SELECT ip_src, sport, ip_dst, dport, proto, count(*) AS n, sum(length) AS b,
  greatest(arg_max(ts, pkt_no) - arg_min(ts, pkt_no), 1e-9) AS d, max(length) AS mx, min(length) AS mn,
  avg(ttl) AS ttl, coalesce(max(tcp_window) FILTER (WHERE proto = 6), 0) AS w,
  count(*) FILTER (WHERE proto = 6 AND tcp_flags & 2 <> 0) AS syn,
  count(*) FILTER (WHERE proto = 6 AND tcp_flags & 1 <> 0) AS fin,
  count(*) FILTER (WHERE proto = 6 AND tcp_flags & 4 <> 0) AS rst FROM keyed GROUP BY ALL)
SELECT ip_src, sport, ip_dst, dport, CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS proto,
  trunc(d * 1000000)::BIGINT AS duration, n AS packets, mx::INT AS longest, mn::INT AS shortest,
  round(b::DOUBLE / n, 6) AS mean_len, round(b / d / 1e6, 4) AS mbytes_s, round(n / d / 1e3, 4) AS kpackets_s,
  syn, fin, rst, round(ttl, 6) AS ttl, w::DOUBLE AS tcp_window FROM g""",
)
def packet_flows(spark, sf):
    """Directed flows built from packets."""
    f = ops.packet_flows(packets(spark, sf))
    return f.select(
        F.col("Source IP").alias("ip_src"),
        F.col("Source Port").alias("sport"),
        F.col("Destination IP").alias("ip_dst"),
        F.col("Destination Port").alias("dport"),
        F.col("Protocol").alias("proto"),
        F.col("Flow Duration").alias("duration"),
        F.col("Total Fwd Packets").alias("packets"),
        F.col("Fwd Packet Length Max").alias("longest"),
        F.col("Fwd Packet Length Min").alias("shortest"),
        F.round("Fwd Packet Length Mean", 6).alias("mean_len"),
        F.round(F.col("Flow Bytes/s") / 1e6, 4).alias("mbytes_s"),
        F.round(F.col("Flow Packets/s") / 1e3, 4).alias("kpackets_s"),
        F.col("SYN Flag Count").alias("syn"),
        F.col("FIN Flag Count").alias("fin"),
        F.col("RST Flag Count").alias("rst"),
        F.round("ip_ttl_mean", 6).alias("ttl"),
        F.col("tcp_window_max").alias("tcp_window"),
    )


@query(
    "sorted_packet_flows",
    f"""WITH {VIEWS}, g AS (SELECT ip_src, ip_dst, sport, dport,
  CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS proto FROM keyed GROUP BY ALL)
SELECT ip_src, ip_dst, sport, dport, proto FROM g ORDER BY ALL""",
)
def sorted_packet_flows(spark, sf):
    f = ops.sort_flows(ops.packet_flows(packets(spark, sf)))
    return f.select(
        F.col("Source IP").alias("ip_src"),
        F.col("Destination IP").alias("ip_dst"),
        F.col("Source Port").alias("sport"),
        F.col("Destination Port").alias("dport"),
        F.col("Protocol").alias("proto"),
    )


PLAIN = """plain AS (SELECT flow_key, max(length(q)) AS l, max(ent) AS e, max(length(line)) AS h
FROM (SELECT flow_key, q, line, (SELECT list_sum(list_transform(list_distinct(x), lambda b:
    -(len(list_filter(x, lambda y: y = b))::DOUBLE / len(x))
      * log2(len(list_filter(x, lambda y: y = b))::DOUBLE / len(x) + 1e-12)))
    FROM (SELECT string_split(q, '') AS x)) AS ent
  FROM (SELECT flow_key, CASE WHEN proto = 17 AND dport = 53 THEN regexp_replace(dns_qname, '\\.+$', '') END AS q,
    CASE WHEN proto = 6 AND dport = 80 AND starts_with(http_text, 'GET ')
      THEN string_split(http_text, chr(13) || chr(10))[1] END AS line FROM keyed)
  WHERE q IS NOT NULL OR line IS NOT NULL) GROUP BY flow_key)"""


@query(
    "plaintext_packet_stats",
    f"""WITH {VIEWS}, {PLAIN}
SELECT flow_key, coalesce(l, 0)::DOUBLE AS pcap_dns_qname_len_max,
  round(coalesce(e, 0), 6) AS pcap_dns_qname_entropy_max,
  coalesce(h, 0)::DOUBLE AS pcap_http_first_line_len_max, 1.0::DOUBLE AS pcap_plaintext_hits FROM plain""",
)
def plaintext_packet_stats(spark, sf):
    s = ops.plaintext_stats(packets(spark, sf))
    return s.withColumn(
        "pcap_dns_qname_entropy_max", F.round("pcap_dns_qname_entropy_max", 6)
    )


@query(
    "plaintext_on_flows",
    f"""WITH {VIEWS}, {PLAIN}
SELECT k.flow_key, coalesce(l, 0)::DOUBLE AS name_len, coalesce(h, 0)::DOUBLE AS line_len,
  CASE WHEN p.flow_key IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hits
FROM (SELECT DISTINCT flow_key FROM keyed) k LEFT JOIN plain p USING (flow_key)""",
)
def plaintext_on_flows(spark, sf):
    """Packet statistics joined to flows, zero where a flow has none."""
    p = packets(spark, sf)
    joined = ops.join_plaintext(with_flow_key(ops.packet_flows(p)), ops.plaintext_stats(p))
    return joined.select(
        "flow_key",
        F.col("pcap_dns_qname_len_max").alias("name_len"),
        F.col("pcap_http_first_line_len_max").alias("line_len"),
        F.col("pcap_plaintext_hits").alias("hits"),
    )


@query(
    "byte_entropy",
    """
SELECT page_id, round(coalesce((SELECT sum(-(n / t) * log2(n / t + 1e-12)) FROM
  (SELECT count(*)::DOUBLE AS n, (SELECT length(hex(encode(url)))::DOUBLE / 2) AS t FROM
    (SELECT unnest(regexp_extract_all(hex(encode(url)), '..')) AS b) GROUP BY b)), 0), 6) AS entropy
FROM pages""",
)
def byte_entropy(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.round(text.byte_entropy(F.encode("url", "UTF-8")), 6).alias("entropy")
    )


@query(
    "http_request_lines",
    f"""WITH {VIEWS}
SELECT flow_key, pkt_no, string_split(http_text, chr(13) || chr(10))[1] AS line FROM keyed
WHERE proto = 6 AND dport = 80 AND starts_with(http_text, 'GET ')""",
)
def http_request_lines(spark, sf):
    p = ops.with_packet_key(packets(spark, sf)).filter("proto = 6")
    lines = p.select("flow_key", "pkt_no", text.http_line(F.col("payload")).alias("line"))
    return lines.filter(F.col("line").isNotNull())


_VEC = [
    "least(ip_len, 1500) / 1500.0",
    "ttl / 255.0",
    "(proto = 6)::INT",
    "(proto = 17)::INT",
    "(proto NOT IN (6, 17))::INT",
    *[f"CASE WHEN proto = 6 THEN (tcp_flags >> {i}) & 1 ELSE 0 END" for i in range(6)],
    "CASE proto WHEN 6 THEN least(ip_declared_len - ip_len, 1500) / 1500.0 "
    "WHEN 17 THEN least(udp_len, 1500) / 1500.0 ELSE 0 END",
]


@query(
    "packet_vectors",
    f"WITH {VIEWS} SELECT flow_key, pkt_no, "
    + ", ".join(f"round(({e})::DOUBLE, 5) AS v{i}" for i, e in enumerate(_VEC))
    + " FROM keyed",
)
def packet_vectors(spark, sf):
    p = ops.with_packet_key(packets(spark, sf))
    v = scoring.packet_vector(
        F.col("ip_len"),
        F.col("ttl"),
        F.col("proto"),
        F.col("tcp_flags"),
        F.col("ip_declared_len") - F.col("ip_len"),
        F.col("udp_len"),
    )
    return p.withColumn("v", v).select(
        "flow_key",
        "pkt_no",
        *[F.round(F.col("v")[i].cast("double"), 5).alias(f"v{i}") for i in range(12)],
    )


@query(
    "packet_sequences",
    f"""WITH {VIEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY pkt_no) AS n FROM keyed),
slots AS (SELECT flow_key, unnest(generate_series(1, 16)) AS n FROM (SELECT DISTINCT flow_key FROM keyed))
SELECT flow_key, n::INT AS slot, """
    + ", ".join(f"round(CASE WHEN pkt_no IS NULL THEN 0 ELSE ({e})::DOUBLE END, 5) AS v{i}" for i, e in enumerate(_VEC) if i in (0, 1, 6, 11))
    + " FROM slots LEFT JOIN r USING (flow_key, n)",
)
def packet_sequences(spark, sf):
    """The first sixteen packets of each flow, zero rows after the last."""
    s = ops.packet_sequences(packets(spark, sf))
    rows = s.select("flow_key", F.posexplode("sequence").alias("slot", "v"))
    return rows.select(
        "flow_key",
        (F.col("slot") + 1).alias("slot"),
        *[F.round(F.col("v")[i].cast("double"), 5).alias(f"v{i}") for i in (0, 1, 6, 11)],
    )


@query(
    "first_packets_per_flow",
    f"""WITH {VIEWS}
SELECT flow_key, pkt_no, n::INT AS slot FROM (SELECT flow_key, pkt_no,
  row_number() OVER (PARTITION BY flow_key ORDER BY pkt_no) AS n FROM keyed) WHERE n <= 3""",
)
def first_packets_per_flow(spark, sf):
    return ops.first_packets(ops.with_packet_key(packets(spark, sf)), 3).select(
        "flow_key", "pkt_no", "slot"
    )


@query(
    "direction_matched_packets",
    f"""WITH {VIEWS}, {WANTED}, r AS (SELECT *, concat(ip_dst, '|', dport, '|', ip_src, '|', sport, '|',
  string_split(flow_key, '|')[5]) AS back FROM keyed)
SELECT coalesce(f.flow_key, b.flow_key) AS flow_key, pkt_no FROM r
LEFT JOIN wanted f ON f.flow_key = r.flow_key LEFT JOIN wanted b ON b.flow_key = r.back
WHERE f.flow_key IS NOT NULL OR b.flow_key IS NOT NULL""",
)
def direction_matched_packets(spark, sf):
    """Packets of wanted flows, in either direction, under the wanted key."""
    keyed = ops.with_packet_key(packets(spark, sf))
    return ops.match_direction(keyed, wanted_keys(spark, sf)).select("flow_key", "pkt_no")


HEADERS = """r AS (SELECT flow_key, header_hex, row_number() OVER (PARTITION BY flow_key ORDER BY pkt_no) AS n FROM keyed),
blocks AS (SELECT flow_key, rpad(string_agg(header_hex, '' ORDER BY n), 1920, '0') AS h FROM r
  WHERE n <= 24 GROUP BY flow_key)"""


@query(
    "header_byte_blocks",
    f"WITH {VIEWS}, {HEADERS} SELECT flow_key, md5(h) AS digest, length(h) // 2 AS width FROM blocks",
)
def header_byte_blocks(spark, sf):
    """24 × 40 header bytes of each flow."""
    b = ops.header_blocks(packets(spark, sf))
    return b.select(
        "flow_key",
        F.md5(F.hex("header_bytes").cast("binary")).alias("digest"),
        F.octet_length("header_bytes").cast("long").alias("width"),
    )


@query(
    "scaled_header_vectors",
    f"""WITH {VIEWS}, {HEADERS}, f AS (SELECT DISTINCT flow_key, l_orderkey % 2 AS kept FROM keyed),
x AS (SELECT f.flow_key, CASE WHEN kept = 1 THEN list_transform(generate_series(0, 959),
  lambda i: ('0x' || substr(h, (i * 2 + 1)::INT, 2))::INT / 255.0) END AS v FROM f LEFT JOIN blocks USING (flow_key))
SELECT flow_key, round(coalesce(list_sum(v), 0), 3) AS total, round(coalesce(v[1], 0), 5) AS first_byte,
  coalesce(len(v), 960)::INT AS width FROM x""",
)
def scaled_header_vectors(spark, sf):
    """Header bytes scaled to 0..1 on flows; zeros where a flow has no block."""
    keyed = ops.with_packet_key(packets(spark, sf))
    flow_rows = keyed.select("flow_key", (F.col("l_orderkey") % 2).alias("kept")).distinct()
    joined = ops.join_header_bytes(flow_rows, ops.header_blocks(packets(spark, sf)))
    v = ops.scaled_header(F.when(F.col("kept") == 1, F.col("header_bytes")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return joined.withColumn("v", v).select(
        "flow_key",
        F.round(total, 3).alias("total"),
        F.round(F.col("v")[0].cast("double"), 5).alias("first_byte"),
        F.size("v").alias("width"),
    )


@query(
    "sequences_on_flows",
    f"""WITH {VIEWS}, s AS (SELECT flow_key, least(count(*), 16) AS n FROM keyed WHERE proto = 6 GROUP BY 1)
SELECT k.flow_key, s.flow_key IS NOT NULL AS found, coalesce(n, 0)::BIGINT AS filled, 16 AS slots
FROM (SELECT DISTINCT flow_key FROM keyed) k LEFT JOIN s USING (flow_key)""",
)
def sequences_on_flows(spark, sf):
    """Flows with their packet tensor and the found mask (TCP packets only here)."""
    p = packets(spark, sf)
    flow_rows = with_flow_key(ops.packet_flows(p)).select("flow_key")
    joined = ops.join_sequences(flow_rows, ops.packet_sequences(p.filter("proto = 6")))
    filled = F.size(F.filter("sequence", lambda v: v[2] > 0)).cast("long")
    return joined.select(
        "flow_key", "found", filled.alias("filled"), F.size("sequence").alias("slots")
    )


@query(
    "header_signal_quality",
    f"""WITH {VIEWS}, {HEADERS},
b AS (SELECT i, ('0x' || substr(h, (i * 2 + 1)::INT, 2))::INT / 255.0 AS x
  FROM blocks, (SELECT unnest(generate_series(0, 959)) AS i)),
c AS (SELECT i, coalesce(var_samp(x), 0) AS v, count(*) FILTER (WHERE x <> 0) AS nz, count(*) AS n FROM b GROUP BY i)
SELECT 960 AS columns_present, round(sum(nz)::DOUBLE / sum(n), 8) AS nonzero_fraction,
  round(avg(v), 6) AS variance_mean, 'good' AS signal_quality FROM c""",
)
def header_signal_quality(spark, sf):
    q = ops.header_quality(ops.header_blocks(packets(spark, sf)))
    return q.withColumn("variance_mean", F.round("variance_mean", 6))


@query(
    "training_slice",
    f"""WITH {FLOWS}, b AS (SELECT row_id, 'benign' AS source_file FROM flows WHERE event_type = 'view'
  ORDER BY row_id LIMIT 35000),
a AS (SELECT row_id, concat('f', "Protocol") AS source_file, row_number() OVER (PARTITION BY "Protocol"
  ORDER BY md5(concat(row_id, ':42')), row_id) AS n FROM flows WHERE "Label" <> 'BENIGN')
SELECT row_id, source_file FROM b UNION ALL SELECT row_id, source_file FROM a WHERE n <= 6000""",
)
def training_slice(spark, sf):
    """Head of the benign rows and a capped, reproducible pick of attacks per file."""
    f = flows(spark, sf)
    benign = f.filter("event_type = 'view'").withColumn("source_file", F.lit("benign"))
    attacks = f.withColumn("source_file", F.concat(F.lit("f"), F.col("Protocol")))
    return sampling.training_slice(benign, attacks).select("row_id", "source_file")


@query(
    "slice_union",
    f"""WITH {FLOWS}
SELECT "Label" AS label, count(*) AS n FROM (SELECT "Label" FROM flows WHERE event_type = 'error'
  UNION ALL SELECT "Label" FROM flows) GROUP BY 1""",
)
def slice_union(spark, sf):
    """Bag union of slices: repeated rows stay."""
    f = flows(spark, sf)
    return (
        f.filter("event_type = 'error'")
        .unionByName(f)
        .groupBy(F.col("Label").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "row_limit",
    f"WITH {FLOWS} SELECT row_id, \"Source IP\" AS ip FROM flows ORDER BY row_id LIMIT 1000",
)
def row_limit(spark, sf):
    """The scan limit: first rows in table order."""
    return sampling.limit_rows(flows(spark, sf), 1000).select(
        "row_id", F.col("Source IP").alias("ip")
    )


@query(
    "positional_split",
    f"""WITH {FLOWS}, r AS (SELECT row_id, row_number() OVER (ORDER BY "Timestamp", row_id) AS n,
  count(*) OVER () AS c FROM flows) SELECT row_id, n > floor(c * 0.8)::BIGINT AS validation FROM r""",
)
def positional_split(spark, sf):
    train, held = sampling.positional_split(flows(spark, sf), 0.2, ("Timestamp", "row_id"))
    return (
        train.withColumn("validation", F.lit(False))
        .unionByName(held.withColumn("validation", F.lit(True)))
        .select("row_id", "validation")
    )


@query(
    "stratified_split",
    f"""WITH {FLOWS}
SELECT "Label", ('0x' || substr(md5(concat(row_id, ':42:', "Label")), 1, 8))::BIGINT % 10000 < 2000 AS validation,
  count(*) AS n FROM flows GROUP BY ALL""",
)
def stratified_split(spark, sf):
    """Class shares on both sides of the hash split."""
    train, held = sampling.stratified_split(flows(spark, sf), "Label")
    return (
        train.withColumn("validation", F.lit(False))
        .unionByName(held.withColumn("validation", F.lit(True)))
        .groupBy("Label", "validation")
        .agg(F.count(F.lit(1)).alias("n"))
    )
