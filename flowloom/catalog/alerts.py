"""Scoring, detection and alert-browsing queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from flowloom.catalog.base import FLOWS, FLOWS_URI, SIEM, flows, query, siem, table
from flowloom.catalog.traffic import B, HOUR, MULTIPLIER, bucket_views
from flowloom.functions import scoring, text
from flowloom.functions.cleaning import micros, name
from flowloom.operators import alerts as ops
from flowloom.operators import correlation, suppression
from flowloom.plans.detect import cascade, detect, join_scores
from flowloom.session import materialize
from flowloom.settings import CHANNELS, Settings
from flowloom.sources import sinks

CFG = Settings(bucket_seconds=HOUR, syn_multiplier=MULTIPLIER)
OPEN = replace(CFG, gate_on_level1=False)

# --- the detection job as SQL ---
_SHORT = {
    "rf": "l2_rf_attack_score",
    "lstm": "l2_lstm_attack_score",
    "pkt": "l2_lstm_pkt_score",
    "emb": "l2_emb_attack_score",
    "hdr": "l2_hdr_cnn_attack_score",
    "ae": "l2_ae_ratio",
}
NETWORK = (
    "greatest(0.0, least(1.0, 0.20 * (1 - exp(-greatest(ae, 0.0) / 3.0)) + 0.34 * rf + 0.10 * lstm "
    "+ 0.06 * pkt + 0.11 * emb + 0.14 * hdr - CASE WHEN rf >= 0.999 AND emb >= 0.999 "
    "AND 1 - exp(-greatest(ae, 0.0) / 3.0) >= 0.98 THEN 0.08 ELSE 0.0 END))"
)
RULES = """list_filter([CASE WHEN "Flow Packets/s" > 400 THEN 'high_packet_rate' END,
  CASE WHEN "Flow Bytes/s" > 350000 THEN 'high_byte_rate' END,
  CASE WHEN "SYN Flag Count" >= 1 AND "RST Flag Count" >= 1 THEN 'syn_rst_combo' END,
  CASE WHEN "Destination Port" NOT IN (80, 443, 53) AND "Destination Port" > 0
    THEN 'unusual_destination_port' END,
  CASE WHEN regexp_matches(lower(http_request_uri), '/admin|/wp-login|/\\.env|/login|/phpmyadmin')
    THEN 'suspicious_uri_pattern' END], lambda x: x IS NOT NULL)"""
BAND = """CASE WHEN {0} >= 90 THEN 'Emergency' WHEN {0} >= 80 THEN 'Critical' WHEN {0} >= 65 THEN 'High'
  WHEN {0} >= 50 THEN 'Medium' WHEN {0} >= 30 THEN 'Low' ELSE 'Info' END"""
WITH_URI = bucket_views().replace(FLOWS, FLOWS_URI)


def alerts_sql(gate: bool, siem_on: bool, threshold: float = 45.0, demo: bool = False) -> str:
    """CTEs ending in ``alerts``."""
    shut = "CASE WHEN spike THEN {0} ELSE 0.0 END" if gate else "{0}"
    channels = ", ".join(f"{shut.format(c)} AS {k}" for k, c in _SHORT.items())
    hit = "rf >= 0.5 OR lstm >= 0.5 OR pkt >= 0.5 OR emb >= 0.5 OR hdr >= 0.5 OR ae >= 1.5"
    keep = "true" if demo else (f"l1 AND ({hit})" if gate else hit)
    raw = "100.0 * with_rules"
    if siem_on:
        raw = f"least(100.0, {raw} + coalesce(failed_login, 0) * 15.0 + coalesce(config_change, 0) * 10.0)"
        counts = ", coalesce(failed_login, 0)::BIGINT AS siem_failed_login, coalesce(config_change, 0)::BIGINT AS siem_config_change"
        join = """LEFT JOIN (SELECT ip, count(*) FILTER (WHERE event_type = 'failed_login') AS failed_login,
  count(*) FILTER (WHERE event_type = 'config_change') AS config_change FROM siem GROUP BY ip) c USING (ip)"""
    else:
        counts, join = ", NULL::BIGINT AS siem_failed_login, NULL::BIGINT AS siem_config_change", ""
    return f"""{WITH_URI}, {SIEM},
scored AS (SELECT row_id, "Source IP" AS ip, "Timestamp" AS ts, spike AS l1, {RULES} AS rules, {channels}
  FROM (SELECT *, {B} AS bucket FROM flows) JOIN spikes USING (bucket)),
fused AS (SELECT *, {NETWORK} AS network FROM scored WHERE {keep}),
boosted AS (SELECT *, least(1.0, greatest(0.0, network + least(0.16, len(rules) * 0.035::DOUBLE))) AS with_rules FROM fused),
graded AS (SELECT *, {raw} AS raw{counts} FROM boosted {join}),
alerts AS (SELECT row_id AS alert_seq, ip, ts, round(raw, 2) AS threat_score,
  {BAND.format("raw" if siem_on else "round(raw, 2)")} AS severity, siem_failed_login, siem_config_change,
  l1 AS l1_triggered, round(rf, 4) AS l2_rf_attack_score, round(ae, 4) AS l2_ae_ratio,
  round(lstm, 4) AS l2_lstm_attack_score, round(emb, 4) AS l2_emb_attack_score,
  round(hdr, 4) AS l2_hdr_cnn_attack_score, round(pkt, 4) AS l2_lstm_pkt_score,
  round(network, 6) AS network_score, round(with_rules, 6) AS network_score_with_rules,
  array_to_string(rules, ',') AS rules, CASE WHEN len(rules) > 0 THEN 'rule+ml fusion' ELSE 'ml-only' END AS reason
  FROM graded WHERE round(raw, 2) >= {threshold})"""


FLAT = """SELECT alert_seq, ip, epoch_us(ts) AS micros, threat_score, severity, siem_failed_login,
  siem_config_change, l1_triggered, l2_rf_attack_score, l2_ae_ratio, l2_hdr_cnn_attack_score,
  network_score, network_score_with_rules, rules, reason FROM alerts"""


def flat(alerts):
    return alerts.select(
        "alert_seq",
        "ip",
        micros(F.col("ts")).alias("micros"),
        "threat_score",
        "severity",
        "siem_failed_login",
        "siem_config_change",
        "l1_triggered",
        "l2_rf_attack_score",
        "l2_ae_ratio",
        "l2_hdr_cnn_attack_score",
        F.col("model_signals.network_score").alias("network_score"),
        F.col("model_signals.network_score_with_rules").alias("network_score_with_rules"),
        F.array_join("triggered_rules", ",").alias("rules"),
        "reason",
    )


def open_alerts(spark, sf, cfg=OPEN, with_siem=True):
    events = siem(spark, sf) if with_siem else None
    return detect(flows(spark, sf, uri=True), cfg, siem=events)


@query("detect_alerts", f"WITH {alerts_sql(True, True)} {FLAT}")
def detect_alerts(spark, sf):
    """The detection job, level-1 gated, with SIEM correlation."""
    return flat(open_alerts(spark, sf, CFG))


@query("detect_alerts_ungated", f"WITH {alerts_sql(False, False)} {FLAT}")
def detect_alerts_ungated(spark, sf):
    """Every flow scored, no SIEM source."""
    return flat(open_alerts(spark, sf, OPEN, with_siem=False))


@query("detect_demo_mode", f"WITH {alerts_sql(False, True, 0.0, demo=True)} {FLAT}")
def detect_demo_mode(spark, sf):
    """An alert for every flow."""
    return flat(detect(flows(spark, sf, uri=True), CFG, siem=siem(spark, sf), demo=True))


@query(
    "gated_channel_scores",
    f"""WITH {bucket_views()} SELECT row_id, spike AS l1_triggered, """
    + ", ".join(f"CASE WHEN spike THEN {c} ELSE 0.0 END AS {c}" for c in CHANNELS.values() if "emb" not in c)
    + f", 0.0::DOUBLE AS l2_emb_attack_score FROM (SELECT *, {B} AS bucket FROM flows) JOIN spikes USING (bucket)",
)
def gated_channel_scores(spark, sf):
    """The cascade with one model absent: its column is zero, the rest gated."""
    f = flows(spark, sf).drop("l2_emb_attack_score")
    return cascade(f, CFG).select("row_id", "l1_triggered", *CHANNELS.values())


@query(
    "network_scores",
    f"""WITH {FLOWS}, c AS (SELECT row_id, {", ".join(f"{c} AS {k}" for k, c in _SHORT.items())} FROM flows)
SELECT row_id, round({NETWORK}, 6) AS network_score FROM c""",
)
def network_scores(spark, sf):
    return flows(spark, sf).select(
        "row_id", F.round(scoring.network_score(), 6).alias("network_score")
    )


@query(
    "rule_signals",
    f"""WITH {FLOWS_URI}, r AS (SELECT row_id, event_type, {RULES} AS rules FROM flows)
SELECT row_id, CASE WHEN event_type IN ('view', 'click') THEN '' ELSE array_to_string(rules, ',') END AS rules,
  round(CASE WHEN event_type IN ('view', 'click') THEN 0.0 ELSE least(0.16, len(rules) * 0.035::DOUBLE) END, 6) AS boost FROM r""",
)
def rule_signals(spark, sf):
    """Rules and boost; an unreadable or missing port drops all rules of its row."""
    kind = F.col("event_type")
    port = F.when(kind == "view", F.lit("n/a")).when(kind != "click", F.col("Destination Port").cast("string"))
    return _signals(flows(spark, sf, uri=True).withColumn("Destination Port", port))


@query(
    "rule_signals_missing_port",
    f"""WITH {FLOWS_URI}, r AS (SELECT row_id, event_type, {RULES} AS rules FROM flows)
SELECT row_id, CASE WHEN event_type = 'error' THEN '' ELSE array_to_string(rules, ',') END AS rules,
  round(CASE WHEN event_type = 'error' THEN 0.0 ELSE least(0.16, len(rules) * 0.035::DOUBLE) END, 6) AS boost FROM r""",
)
def rule_signals_missing_port(spark, sf):
    """The same on whole-number ports, null for some rows."""
    f = flows(spark, sf, uri=True)
    return _signals(f.withColumn("Destination Port", F.when(F.col("event_type") != "error", F.col("Destination Port"))))


def _signals(f):
    rules = scoring.rule_conditions(dict(f.dtypes))
    return f.select(
        "row_id",
        F.array_join(scoring.rule_names(rules), ",").alias("rules"),
        F.round(scoring.rule_boost(rules), 6).alias("boost"),
    )


@query(
    "effective_rates",
    """SELECT event_id AS row_id, round(value * 5, 6) AS pps,
  round(CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE (value * 30 + event_id) / ((event_id % 4) * 0.5) END, 6) AS bps FROM events""",
)
def effective_rates(spark, sf):
    """Fallback rates of tables that lack the flow-level rate columns."""
    f = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        (F.col("value") * 2).alias("Fwd Packets/s"),
        (F.col("value") * 3).alias("Bwd Packets/s"),
        (F.col("value") * 30).alias("Total Length of Fwd Packets"),
        F.col("event_id").alias("Total Length of Bwd Packets"),
        ((F.col("event_id") % 4) * 0.5).alias("Flow Duration"),
    )
    pps, bps = scoring.effective_rates(dict(f.dtypes))
    return f.select("row_id", F.round(pps, 6).alias("pps"), F.round(bps, 6).alias("bps"))


@query(
    "threat_grades",
    f"""WITH s AS (SELECT event_id AS row_id, least(100.0, CASE WHEN event_id % 1200 <= 1009
    THEN 100.0 * ((event_id % 1200) / 1009.0::DOUBLE) ELSE (event_id % 1200) / 1009.0::DOUBLE END
  + (event_id % 3) * 15.0 + (event_id % 2) * 10.0)::DOUBLE AS raw, event_id % 6 > 0 AS signal FROM events)
SELECT row_id, round(raw, 2) AS threat_score, {BAND.format("raw")} AS severity,
  CASE WHEN raw >= 80 THEN 'high' WHEN raw >= 55 THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN raw < 50 AND raw >= 30 THEN CASE WHEN signal THEN 'Low: add' ELSE 'Low: monitor' END
    ELSE concat({BAND.format("raw")}, ':') END AS advice FROM s""",
)
def threat_grades(spark, sf):
    """Threat score, band, priority and advice from score and SIEM counts."""
    i = F.col("event_id")
    net = (i % 1200) / F.lit(1009.0)
    failed, changed = i % 3, i % 2
    raw = scoring.threat_score_raw(net, failed, changed, CFG)
    graded = table(spark, sf, "events").select(
        i.alias("row_id"), raw.alias("raw"), ((failed > 0) | (changed > 0)).alias("signal")
    ).withColumn("severity", scoring.severity(F.col("raw")))
    advice = scoring.recommendation(F.col("severity"), F.col("signal"))
    words = F.when(F.col("severity") == "Low", 2).otherwise(1)
    short = F.array_join(F.slice(F.split(advice, " "), F.lit(1), words), " ")
    return graded.select(
        "row_id",
        F.round("raw", 2).alias("threat_score"),
        "severity",
        scoring.priority(F.col("raw")).alias("priority"),
        short.alias("advice"),
    )


@query(
    "suspicious_uris",
    f"""WITH {FLOWS_URI} SELECT row_id,
  regexp_matches(lower(http_request_uri), '/admin|/wp-login|/\\.env|/login|/phpmyadmin') AS suspicious FROM flows""",
)
def suspicious_uris(spark, sf):
    return flows(spark, sf, uri=True).select(
        "row_id", text.is_suspicious_uri(F.col("http_request_uri")).alias("suspicious")
    )


@query(
    "synthetic_sources",
    f"""WITH {FLOWS} SELECT row_id AS alert_seq, concat('10.0.0.', row_id % 250) AS ip FROM flows
WHERE l2_rf_attack_score >= 0.5 OR l2_lstm_attack_score >= 0.5 OR l2_lstm_pkt_score >= 0.5
  OR l2_emb_attack_score >= 0.5 OR l2_hdr_cnn_attack_score >= 0.5 OR l2_ae_ratio >= 1.5""",
)
def synthetic_sources(spark, sf):
    """Alert sources of a table without addresses."""
    f = flows(spark, sf).drop("Source IP")
    return detect(f, replace(OPEN, alert_threshold=0.0)).select("alert_seq", "ip")


_DAY = 86_400
_SUPPRESS = """k AS (SELECT *, row_number() OVER (PARTITION BY ip, severity ORDER BY alert_seq) AS n FROM a),
r AS (SELECT ip, severity, n, alert_seq, us, us AS last, true AS kept FROM k WHERE n = 1
  UNION ALL SELECT k.ip, k.severity, k.n, k.alert_seq, k.us, CASE WHEN k.us - r.last > {w} THEN k.us ELSE r.last END,
    k.us - r.last > {w} FROM r JOIN k ON k.ip = r.ip AND k.severity = r.severity AND k.n = r.n + 1)"""


@query(
    "suppressed_alerts",
    f"""WITH RECURSIVE {alerts_sql(False, True)},
a AS (SELECT alert_seq, ip, severity, epoch_us(ts) AS us FROM alerts),
{_SUPPRESS.format(w=_DAY * 1_000_000)}
SELECT alert_seq, ip, severity FROM r WHERE kept""",
)
def suppressed_alerts(spark, sf):
    """Alerts left after one-day suppression per source and severity."""
    kept = open_alerts(spark, sf, replace(OPEN, dedup_window_seconds=_DAY))
    return kept.select("alert_seq", "ip", "severity")


@query(
    "suppressed_out_of_order",
    f"""WITH RECURSIVE a AS (SELECT event_id AS alert_seq, event_type AS ip, 'x' AS severity,
  CASE WHEN event_id % 97 = 0 THEN epoch_us(TIMESTAMP '2024-02-01 00:00:00')
    ELSE epoch_us(ts) - (event_id % 13) * 7200000000 END AS us FROM events),
{_SUPPRESS.format(w=3600 * 1_000_000)}
SELECT alert_seq, ip FROM r WHERE kept""",
)
def suppressed_out_of_order(spark, sf):
    """Late and missing times in a few large groups; missing counts as now."""
    import datetime as dt

    late = F.timestamp_micros(
        F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("event_id") % 13) * 7_200_000_000
    )
    a = table(spark, sf, "events").select(
        F.col("event_id").alias("alert_seq"),
        F.col("event_type").alias("ip"),
        F.lit("x").alias("severity"),
        F.when(F.col("event_id") % 97 != 0, late).alias("ts"),
    )
    kept = suppression.suppress(a, 3600, now=dt.datetime(2024, 2, 1))
    return kept.select("alert_seq", "ip")


@query(
    "flow_locations",
    f"""WITH {FLOWS}, g AS (SELECT 203::BIGINT * 16777216 + s_suppkey * 16 AS low,
  203::BIGINT * 16777216 + s_suppkey * 16 + 15 AS high, s_acctbal / 100 AS lat, -s_acctbal / 50 AS lon FROM supplier),
a AS (SELECT row_id, CASE WHEN event_type = 'view' THEN '10.1.1.1' ELSE "Destination IP" END AS dst,
  concat('203.0.0.', row_id % 251) AS src FROM flows),
n AS (SELECT *, 203::BIGINT * 16777216 + string_split(dst, '.')[2]::BIGINT * 65536 + string_split(dst, '.')[4]::BIGINT AS dn,
  203::BIGINT * 16777216 + row_id % 251 AS sn FROM a)
SELECT row_id, round(coalesce(d.lat, s.lat), 6) AS latitude, round(coalesce(d.lon, s.lon), 6) AS longitude FROM n
LEFT JOIN g d ON dst <> '10.1.1.1' AND dn BETWEEN d.low AND d.high LEFT JOIN g s ON sn BETWEEN s.low AND s.high""",
)
def flow_locations(spark, sf):
    """Destination first, then source; private addresses have no place."""
    start = F.lit(203 * 2**24).cast("long") + F.col("s_suppkey") * 16
    ranges = table(spark, sf, "supplier").select(
        start.alias("low"),
        (start + 15).alias("high"),
        (F.col("s_acctbal") / 100).alias("latitude"),
        (-F.col("s_acctbal") / 50).alias("longitude"),
    )
    f = flows(spark, sf).select(
        "row_id",
        F.when(F.col("event_type") == "view", "10.1.1.1")
        .otherwise(F.col("Destination IP"))
        .alias("dst_ip"),
        F.concat(F.lit("203.0.0."), F.col("row_id") % 251).alias("ip"),
    )
    located = correlation.join_locations(f, ranges)
    return located.select(
        "row_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude")
    )


@query(
    "packet_scores_on_flows",
    f"""WITH {FLOWS}, s AS (SELECT o_custkey % 150 AS u, arg_max(o_orderkey % 1000 / 1000.0::DOUBLE, o_orderkey) AS score
  FROM orders GROUP BY 1)
SELECT row_id, coalesce(score, 0.0) AS l2_lstm_pkt_score FROM flows LEFT JOIN s
  ON concat('10.0.', u // 250, '.', u % 250) = "Source IP" """,
)
def packet_scores_on_flows(spark, sf):
    """A score table with repeated keys: the last one wins, missing is 0."""
    u = F.col("o_custkey") % 150
    key = F.concat(F.lit("10.0."), F.floor(u / 250), F.lit("."), u % 250)
    scores = table(spark, sf, "orders").select(
        key.alias("flow_key"),
        ((F.col("o_orderkey") % 1000) / F.lit(1000.0)).alias("score"),
        F.col("o_orderkey").alias("seq"),
    )
    f = flows(spark, sf).select("row_id", F.col("Source IP").alias("flow_key"))
    return join_scores(f, scores, "l2_lstm_pkt_score").select("row_id", "l2_lstm_pkt_score")


_SUMMARY = """SELECT count(*) AS alert_count, round(avg(threat_score), 4) AS threat_score_mean,
  round(median(threat_score), 4) AS threat_score_median, """ + ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS severity_{s.lower()}"
    for s in ("Emergency", "Critical", "High", "Medium", "Low", "Info")
) + ", count(*) FILTER (WHERE l1_triggered) AS l1_triggered_true_count"


@query("alert_summary", f"WITH {alerts_sql(False, True)} {_SUMMARY} FROM alerts")
def alert_summary(spark, sf):
    return ops.alert_summary(open_alerts(spark, sf))


@query(
    "alert_channel_usage",
    f"WITH {alerts_sql(False, True)} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS channel, round(avg({c}), 6) AS mean, count(*) FILTER (WHERE abs({c}) > 1e-12) AS non_zero_count, "
        f"round(coalesce(stddev_samp({c}), 0), 8) AS std, coalesce(stddev_samp({c}), 0) > 1e-12 AS is_non_constant, "
        f"count(*) FILTER (WHERE abs({c}) > 1e-12) > 0 AS used FROM alerts"
        for k, c in CHANNELS.items()
    ),
)
def alert_channel_usage(spark, sf):
    return ops.channel_stats(open_alerts(spark, sf))


@query(
    "gated_versus_ungated",
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {alerts_sql(g, False, 0.0)} {_SUMMARY.replace('SELECT ', f'SELECT {chr(39)}{m}{chr(39)} AS mode, ', 1)}, "
        "stddev_samp(l2_rf_attack_score) > 1e-12 AS rf_non_constant, count(*) FILTER (WHERE abs(l2_ae_ratio) > 1e-12) > 0 AS ae_non_zero, "
        "stddev_samp(l2_lstm_attack_score) > 1e-12 AS lstm_non_constant FROM alerts)"
        for m, g in (("default_l1_gated", True), ("parallel_l2", False))
    ),
)
def gated_versus_ungated(spark, sf):
    """Both detection modes summarized side by side."""
    f = flows(spark, sf, uri=True)
    gated = detect(f, replace(CFG, alert_threshold=0.0))
    ungated = detect(f, replace(OPEN, alert_threshold=0.0))
    return ops.compare_modes(gated, ungated)


@query(
    "first_alerts",
    f"WITH {alerts_sql(False, True)} SELECT alert_seq, ip, threat_score FROM alerts ORDER BY alert_seq LIMIT 200",
)
def first_alerts(spark, sf):
    """The batch sink's rows: the first 200 alerts."""
    return sinks.first_alerts(open_alerts(spark, sf)).select("alert_seq", "ip", "threat_score")


@query(
    "last_alerts",
    f"WITH {alerts_sql(False, True)} SELECT alert_seq, ip, threat_score FROM alerts ORDER BY alert_seq DESC LIMIT 200",
)
def last_alerts(spark, sf):
    """The realtime sink's rows: the last 200 alerts."""
    return sinks.last_alerts(open_alerts(spark, sf)).select("alert_seq", "ip", "threat_score")


@query(
    "alerts_browsed",
    f"""WITH {alerts_sql(False, True)} SELECT alert_seq, ip, severity, threat_score FROM alerts
WHERE severity IN ('Emergency', 'Critical') AND contains(lower(ip), '0.0.1') AND threat_score >= 85""",
)
def alerts_browsed(spark, sf):
    found = ops.browse(open_alerts(spark, sf), ["new"], ["Emergency", "Critical"], "0.0.1", 85)
    return found.select("alert_seq", "ip", "severity", "threat_score")


@query(
    "alert_defaults",
    f"""WITH {alerts_sql(False, True)} SELECT alert_seq, 'new' AS status, true AS status_defaulted,
  {BAND.format("threat_score")} AS severity FROM alerts""",
)
def alert_defaults(spark, sf):
    """Stored alerts without status and severity, completed on read."""
    bare = open_alerts(spark, sf).drop("status", "severity")
    return ops.with_defaults(bare).select("alert_seq", "status", "status_defaulted", "severity")


@query(
    "alert_filter_options",
    f"""WITH {alerts_sql(False, True)} SELECT 'new' AS status_options,
  (SELECT string_agg(s, ',' ORDER BY i) FROM (SELECT unnest(['Emergency', 'Critical', 'High', 'Medium', 'Low', 'Info']) AS s,
    unnest(generate_series(1, 6)) AS i) WHERE s IN (SELECT severity FROM alerts)) AS severity_options,
  (SELECT count(DISTINCT severity) = 1 FROM alerts) AS single_severity, false AS status_defaulted""",
)
def alert_filter_options(spark, sf):
    o = ops.filter_options(ops.with_defaults(open_alerts(spark, sf)))
    return o.select(
        F.array_join("status_options", ",").alias("status_options"),
        F.array_join("severity_options", ",").alias("severity_options"),
        "single_severity",
        "status_defaulted",
    )


@query(
    "alert_score_series",
    f"""WITH {alerts_sql(False, True)} SELECT epoch_us(date_trunc('hour', ts)) AS slot,
  round(avg(threat_score), 6) AS mean_threat FROM alerts GROUP BY 1""",
)
def alert_score_series(spark, sf):
    """Mean score per slot; the month's span makes the slots hours."""
    s = ops.score_series(open_alerts(spark, sf))
    return s.select(
        micros(F.col("slot")).alias("slot"), F.round("mean_threat", 6).alias("mean_threat")
    )


@query(
    "top_alert_sources",
    f"WITH {alerts_sql(False, True)} SELECT ip, count(*) AS alerts FROM alerts GROUP BY ip ORDER BY 2 DESC, 1 LIMIT 5",
)
def top_alert_sources(spark, sf):
    return ops.top_sources(open_alerts(spark, sf))


@query(
    "alert_map_positions",
    f"""WITH {alerts_sql(False, True)}, o AS (SELECT alert_seq, ip, string_split(ip, '.') AS p,
  row_number() OVER (PARTITION BY ip ORDER BY alert_seq) - 1 AS dup_rank, count(*) OVER (PARTITION BY ip) AS dup_size FROM alerts)
SELECT alert_seq, ip, dup_rank, dup_size,
  round(p[1]::DOUBLE * 256 + p[2]::DOUBLE + (dup_rank - (dup_size - 1) / 2.0) * 0.12, 6) AS map_x,
  round(p[3]::DOUBLE * 256 + p[4]::DOUBLE + (dup_rank - (dup_size - 1) / 2.0) * 0.12, 6) AS map_y FROM o""",
)
def alert_map_positions(spark, sf):
    """Map coordinates with a symmetric offset for repeated addresses."""
    m = ops.map_positions(materialize(open_alerts(spark, sf).select("alert_seq", "ip")))
    return m.select(
        "alert_seq",
        "ip",
        "dup_rank",
        "dup_size",
        F.round("map_x", 6).alias("map_x"),
        F.round("map_y", 6).alias("map_y"),
    )


@query(
    "vector_error_ratio",
    """SELECT vec_id, round(list_sum(list_transform(generate_series(1, len(embedding)), lambda i:
  (embedding[i]::DOUBLE - embedding[len(embedding) + 1 - i]::DOUBLE) ** 2)) / len(embedding) / (0.01 + 1e-9), 4) AS ratio
FROM embeddings""",
)
def vector_error_ratio(spark, sf):
    """Squared error of a vector against its reverse, over a threshold."""
    a = F.col("embedding").cast("array<double>")
    mse = scoring.mean_squared_error(a, F.reverse(a))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(scoring.reconstruction_ratio(mse, 0.01), 4).alias("ratio")
    )


@query(
    "class_probabilities",
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: exp(x::DOUBLE)) AS x FROM embeddings)
SELECT vec_id, round(1 - x[2] / list_sum(x), 6) AS attack_probability,
  round(list_max(x) / list_sum(x), 6) AS without_benign FROM e""",
)
def class_probabilities(spark, sf):
    """Softmax of logits and the attack probability read off it."""
    logits = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    p = table(spark, sf, "embeddings").select("vec_id", scoring.softmax(logits).alias("p"))
    return p.select(
        "vec_id",
        F.round(scoring.attack_probability(F.col("p"), ["ATTACK", "Benign", "X"]), 6).alias(
            "attack_probability"
        ),
        F.round(scoring.attack_probability(F.col("p"), ["A", "B", "C"]), 6).alias("without_benign"),
    )
