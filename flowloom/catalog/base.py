"""Query registry and the flow-shaped views of the given tables.

The given tables are not network flows, so every query first derives flow,
packet, SIEM and score columns from them with integer arithmetic that both
engines evaluate alike. The expressions are kept once, as text; ``{div}`` is
the one spelling that differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.session import spread_small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its counterpart for the value check."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FLOW_COLUMNS = {
    "row_id": "event_id",
    "Timestamp": "CAST(ts AS TIMESTAMP)",
    "Source IP": "concat('10.0.', CAST(user_id {div} 250 AS STRING), '.', CAST(user_id % 250 AS STRING))",
    "Destination IP": "concat('203.', CAST(event_id % 7 AS STRING), '.0.', CAST(event_id % 200 + 1 AS STRING))",
    "Source Port": "CAST(1024 + event_id % 60000 AS INT)",
    "Destination Port": "CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 8080 ELSE 53 END",
    "Protocol": "CASE WHEN event_id % 4 = 1 THEN 17 ELSE 6 END",
    "Flow Duration": "(event_id % 900 + 1) / CAST(1000 AS DOUBLE)",
    "Total Fwd Packets": "event_id % 40 + 1",
    "Total Backward Packets": "event_id % 30",
    "Fwd Packet Length Max": "event_id % 1400 + 64",
    "Fwd Packet Length Min": "event_id % 40 + 20",
    "Fwd Packet Length Mean": "CAST(event_id % 700 + 64 AS DOUBLE)",
    "Bwd Packet Length Max": "event_id % 1500",
    "Flow Packets/s": "value * 4",
    "Flow Bytes/s": "value * 4096",
    "SYN Flag Count": "CAST(event_id % 7 + CASE WHEN event_type = 'error' AND extract(DAY FROM ts) % 5 = 0 THEN 40 ELSE 0 END AS BIGINT)",
    "FIN Flag Count": "event_id % 2",
    "RST Flag Count": "event_id % 3",
    "http_method": "CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'CONNECT' END",
    "Label": "CASE WHEN event_type = 'error' THEN 'PortScan' ELSE 'BENIGN' END",
    "event_type": "event_type",
    "l2_rf_attack_score": "(event_id * 7 % 1000) / CAST(1000 AS DOUBLE)",
    "l2_ae_ratio": "(event_id * 23 % 3000) / CAST(1000 AS DOUBLE)",
    "l2_lstm_attack_score": "(event_id * 11 % 1000) / CAST(1000 AS DOUBLE)",
    "l2_emb_attack_score": "(event_id * 13 % 1000) / CAST(1000 AS DOUBLE)",
    "l2_hdr_cnn_attack_score": "(event_id * 17 % 1000) / CAST(1000 AS DOUBLE)",
    "l2_lstm_pkt_score": "(event_id * 19 % 1000) / CAST(1000 AS DOUBLE)",
}
URI = "concat(url, CASE WHEN event_id % 50 = 0 THEN '/admin' ELSE '' END)"
QNAME = "regexp_extract(url, '^[a-z]+://([^/:?]+)', 1)"

_OCTETS = (
    "concat('10.', CAST((l_orderkey {div} 62500) % 250 AS STRING), '.', "
    "CAST((l_orderkey {div} 250) % 250 AS STRING), '.', CAST(l_orderkey % 250 AS STRING))"
)
PACKET_COLUMNS = {
    "ip_src": _OCTETS,
    "sport": "CAST(1024 + l_orderkey % 60000 AS INT)",
    "ip_dst": "concat('203.0.7.', CAST(l_orderkey % 9 AS STRING))",
    "dport": "CASE l_orderkey % 3 WHEN 0 THEN 80 WHEN 1 THEN 53 ELSE 443 END",
    "proto": "CASE WHEN l_orderkey % 3 = 1 THEN 17 WHEN l_orderkey % 100 = 2 THEN 1 ELSE 6 END",
    # unique within an order on the given tables, and equal in both engines
    "pkt_no": (
        "CAST(l_linenumber AS BIGINT) * 1000000000000000 "
        "+ CAST(extract(YEAR FROM l_shipdate) * 400 + extract(DOY FROM l_shipdate) AS BIGINT) * 10000000000 "
        "+ (l_partkey % 100000) * 100000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000"
    ),
    "length": "CAST(l_quantity * 30 AS INT) + 34",
    "ip_len": "CAST(l_quantity * 30 AS INT) + 20",
    "ip_declared_len": "CAST(l_quantity * 30 AS INT) + 20 + l_linenumber",
    "ttl": "CAST(32 + l_partkey % 200 AS INT)",
    "tcp_flags": "CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 4 ELSE 16 END + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END",
    "tcp_window": "CAST(l_suppkey * 100 AS INT)",
    "udp_len": "CAST(l_quantity * 30 AS INT)",
    "http_text": (
        "CASE WHEN l_partkey % 4 = 0 THEN 'binary' ELSE concat('GET /p', CAST(l_partkey AS STRING), "
        "' HTTP/1.1', chr(13), chr(10), 'Host: s', CAST(l_suppkey AS STRING)) END"
    ),
    "dns_qname": "concat('q', CAST(l_partkey AS STRING), '.host', CAST(l_suppkey AS STRING), '.example.com.')",
    "header_hex": (
        "upper(concat(md5(CAST(l_orderkey AS STRING)), md5(CAST(l_partkey AS STRING)), "
        "substr(md5(CAST(l_linenumber AS STRING)), 1, 16)))"
    ),
}


def spark_text(expr: str) -> str:
    return expr.replace("{div}", "div").replace("chr(", "char(")


def duck_text(expr: str) -> str:
    return expr.replace("{div}", "//").replace("AS STRING", "AS VARCHAR")


def flows(spark: SparkSession, sf_dir: str, uri: bool = False) -> DataFrame:
    """Flow table derived from ``events`` (and ``pages`` for the URI columns)."""
    events = spread_small(table(spark, sf_dir, "events"))
    if not uri:
        return events.selectExpr(
            *[f"{spark_text(e)} AS `{c}`" for c, e in FLOW_COLUMNS.items()]
        )
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    page_count = pages.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    with_page = events.withColumn("page_id", F.col("event_id") % page_count)
    return with_page.join(pages, "page_id", "left").selectExpr(
        *[f"{spark_text(e)} AS `{c}`" for c, e in FLOW_COLUMNS.items()],
        f"{URI} AS http_request_uri",
        f"{QNAME} AS dns_qname",
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet table derived from ``lineitem``: one flow per order."""
    base = spread_small(table(spark, sf_dir, "lineitem")).selectExpr(
        "l_orderkey",
        "CAST(unix_micros(CAST(l_shipdate AS TIMESTAMP)) AS DOUBLE) / 1000000 + l_linenumber AS ts",
        *[f"{spark_text(e)} AS {c}" for c, e in PACKET_COLUMNS.items()],
    )
    return base.withColumns(
        {
            "payload": F.when(F.col("dport") == 80, F.encode("http_text", "UTF-8")),
            "dns_qname": F.when(F.col("dport") == 53, F.col("dns_qname")),
            "ip_bytes": F.unhex("header_hex"),
        }
    ).drop("http_text")


def siem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIEM events derived from three of the event types."""
    return table(spark, sf_dir, "events").filter(
        F.col("event_type").isin("signup", "error", "purchase")
    ).selectExpr(
        f"{spark_text(FLOW_COLUMNS['Source IP'])} AS ip",
        "CASE event_type WHEN 'signup' THEN 'new_user' WHEN 'error' THEN 'failed_login' "
        "ELSE 'config_change' END AS event_type",
        "CAST(ts AS TIMESTAMP) AS timestamp",
    )


# --- the same views for the SQL side ---
_Q = ",\n  ".join(f'{duck_text(e)} AS "{c}"' for c, e in FLOW_COLUMNS.items())
FLOWS = f"flows AS (SELECT {_Q} FROM events)"
FLOWS_URI = (
    f"flows AS (SELECT {_Q},\n  {URI} AS http_request_uri,\n  {QNAME} AS dns_qname\n"
    "FROM events LEFT JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages))"
)
_P = ",\n  ".join(
    f"{duck_text(e)} AS {c}" for c, e in PACKET_COLUMNS.items() if c not in ("dns_qname",)
)
PACKETS = (
    "packets AS (SELECT *, CASE WHEN dport = 53 THEN qname END AS dns_qname,\n"
    "  concat(ip_src, '|', sport, '|', ip_dst, '|', dport, '|',\n"
    "    CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END) AS flow_key\n"
    f"FROM (SELECT l_orderkey, epoch_us(l_shipdate)::DOUBLE / 1000000 + l_linenumber AS ts,\n  {_P},\n"
    f"  {duck_text(PACKET_COLUMNS['dns_qname'])} AS qname FROM lineitem))"
)
SIEM = (
    f"siem AS (SELECT {duck_text(FLOW_COLUMNS['Source IP'])} AS ip,\n"
    "  CASE event_type WHEN 'signup' THEN 'new_user' WHEN 'error' THEN 'failed_login' "
    "ELSE 'config_change' END AS event_type\n"
    "FROM events WHERE event_type IN ('signup', 'error', 'purchase'))"
)
