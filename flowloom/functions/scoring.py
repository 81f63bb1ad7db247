"""Scores, rules and grades of a flow or alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from flowloom.functions.cleaning import name, number_or_zero, parse_double
from flowloom.functions.text import is_suspicious_uri, let
from flowloom.settings import PACKET_FEATURES, Settings

# --- fixed values: weights, cuts and texts of the published scoring ---
CHANNEL_WEIGHTS = {
    "l2_rf_attack_score": 0.34,
    "l2_lstm_attack_score": 0.10,
    "l2_lstm_pkt_score": 0.06,
    "l2_emb_attack_score": 0.11,
    "l2_hdr_cnn_attack_score": 0.14,
}
RECONSTRUCTION_WEIGHT = 0.20
SATURATION_PENALTY = 0.08
RULE_STEP = 0.035
RULE_CAP = 0.16
PACKET_RATE_LIMIT = 400
BYTE_RATE_LIMIT = 350_000
USUAL_PORTS = (80, 443, 53)
SEVERITY_CUTS = (
    (90, "Emergency"),
    (80, "Critical"),
    (65, "High"),
    (50, "Medium"),
    (30, "Low"),
)
RECOMMENDATIONS = {
    "Emergency": "Emergency: block source IP immediately, isolate impacted host/segment, "
    "and escalate incident to on-call security lead.",
    "Critical": "Critical: block source IP at perimeter firewall and start containment; "
    "collect endpoint/network evidence for incident response.",
    "High": "High: tighten monitoring, validate SIEM events, and prepare rapid containment "
    "playbook if activity continues.",
    "Medium": "Medium: open analyst review ticket, inspect source/destination context, "
    "and keep traffic under enhanced observation.",
    "Low": "Low: monitor and log; weak threat signals, no immediate containment required.",
    "Low+siem": "Low: add source to watchlist and monitor recurrence across time windows.",
    "Info": "Info: keep telemetry only; likely benign or scan noise at current confidence.",
    "no_siem": "No SIEM file — network score only.",
}
# --- end of fixed values ---


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def reconstruction_share(ae_ratio: Column) -> Column:
    return 1 - F.exp(-F.greatest(zero_if_null(ae_ratio), F.lit(0.0)) / 3.0)


def network_score(channel: dict[str, Column] | None = None) -> Column:
    """Weighted blend of the channel scores, in [0, 1]."""
    get = channel or {}

    def score(column: str) -> Column:
        return zero_if_null(get.get(column, F.col(column)))

    ae = reconstruction_share(get.get("l2_ae_ratio", F.col("l2_ae_ratio")))
    blend = RECONSTRUCTION_WEIGHT * ae
    for column, weight in CHANNEL_WEIGHTS.items():
        blend = blend + weight * score(column)
    saturated = (
        (score("l2_rf_attack_score") >= 0.999)
        & (score("l2_emb_attack_score") >= 0.999)
        & (ae >= 0.98)
    )
    blend = blend - F.when(saturated, F.lit(SATURATION_PENALTY)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend))


def _measure(types: dict[str, str], column: str) -> Column:
    """A column as a double, 0 where it is missing; text that is no number is NaN.

    Only what the column's type calls for is generated: these expressions run
    per flow and repeat inside filters.
    """
    kind = types.get(column)
    if kind is None:
        return F.lit(0.0)
    if kind == "string":
        text = name(column)
        parsed = F.coalesce(parse_double(text), F.lit(float("nan")))
        return F.when(text.isNull(), F.lit(0.0)).otherwise(parsed)
    return zero_if_null(name(column).cast("double"))


def _above(types: dict[str, str], column: str, value: Column, limit: float) -> Column:
    """``value > limit``; NaN sorts above every number in Spark, so it is ruled out."""
    whole = types.get(column) in ("tinyint", "smallint", "int", "bigint")
    return value > limit if whole else (value > limit) & ~F.isnan(value)


def _at_least_one(types: dict[str, str], column: str) -> Column:
    value = _measure(types, column)
    whole = types.get(column) in ("tinyint", "smallint", "int", "bigint")
    return value >= 1 if whole else (value >= 1) & ~F.isnan(value)


def effective_rates(
    types: dict[str, str], duration_unit: str = "as_is"
) -> tuple[Column, Column]:
    """Packets/s and bytes/s: the flow's own columns where the table has them.

    ``types`` maps column names to type names (``dict(df.dtypes)``).
    ``duration_unit`` is ``as_is`` (the number is divided by unchanged) or
    ``micros`` (packet-derived durations, turned into seconds first).
    """
    if "Flow Packets/s" in types:
        pps = _measure(types, "Flow Packets/s")
    else:
        pps = _measure(types, "Fwd Packets/s") + _measure(types, "Bwd Packets/s")
    if "Flow Bytes/s" in types:
        bps = _measure(types, "Flow Bytes/s")
    else:
        duration = _measure(types, "Flow Duration")
        if duration_unit == "micros":
            duration = duration / 1e6
        total = _measure(types, "Total Length of Fwd Packets") + _measure(
            types, "Total Length of Bwd Packets"
        )
        bps = F.when(duration > 1e-9, total / duration).otherwise(F.lit(0.0))
    return pps, bps


def rule_conditions(types: dict[str, str], duration_unit: str = "as_is") -> dict[str, Column]:
    """Condition of each rule; all are false where the port is unreadable."""
    pps, bps = effective_rates(types, duration_unit)
    port_type = types.get("Destination Port", "int")
    if port_type in ("string", "double", "float"):
        raw = _measure(types, "Destination Port")
        readable = name("Destination Port").isNotNull() & (F.abs(raw) < 1e18)  # false for NaN
        port = F.when(readable, raw).cast("long")
    else:
        known = "Destination Port" in types
        readable = name("Destination Port").isNotNull() if known else None
        port = name("Destination Port").cast("long") if known else F.lit(0)
    uri = name("http_request_uri") if "http_request_uri" in types else F.lit("")
    conditions = {
        "high_packet_rate": _above(types, "Flow Packets/s", pps, PACKET_RATE_LIMIT),
        "high_byte_rate": _above(types, "Flow Bytes/s", bps, BYTE_RATE_LIMIT),
        "syn_rst_combo": _at_least_one(types, "SYN Flag Count") & _at_least_one(types, "RST Flag Count"),
        "unusual_destination_port": ~port.isin(*USUAL_PORTS) & (port > 0),
        "suspicious_uri_pattern": is_suspicious_uri(uri),
    }
    if readable is None:
        return conditions
    return {k: readable & c for k, c in conditions.items()}


def rule_names(conditions: dict[str, Column]) -> Column:
    """Names of the triggered rules, in their fixed order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]))


def rule_boost(conditions: dict[str, Column]) -> Column:
    """Score added by the triggered rules, without building the name array."""
    count = F.lit(0)
    for c in conditions.values():
        count = count + F.when(c, 1).otherwise(0)
    return F.least(F.lit(RULE_CAP), count * F.lit(RULE_STEP))


def alert_predicate(gate: bool) -> Column:
    """Whether the channel scores of a flow alone make it an alert."""
    hit = zero_if_null(F.col("l2_ae_ratio")) >= 1.5
    for column in CHANNEL_WEIGHTS:
        hit = hit | (zero_if_null(F.col(column)) >= 0.5)
    return hit & F.coalesce(F.col("l1_triggered"), F.lit(True)) if gate else hit


def threat_score_raw(
    network: Column, failed_login: Column, config_change: Column, cfg: Settings
) -> Column:
    """Score in 0–100 with the SIEM additions, before rounding."""
    base = F.when(network <= 1.0, 100.0 * network).otherwise(
        F.least(network, F.lit(100.0))
    )
    boosted = (
        base
        + failed_login * F.lit(cfg.siem_boost_failed_login)
        + config_change * F.lit(cfg.siem_boost_config_change)
    )
    return F.least(F.lit(100.0), boosted)


def severity(score: Column) -> Column:
    out = None
    for cut, label in SEVERITY_CUTS:
        out = (
            F.when(score >= cut, F.lit(label))
            if out is None
            else out.when(score >= cut, F.lit(label))
        )
    return out.otherwise(F.lit("Info"))


def recommendation(severity_col: Column, has_siem_signal: Column) -> Column:
    text = F.when(
        (severity_col == "Low") & has_siem_signal, F.lit(RECOMMENDATIONS["Low+siem"])
    )
    for label in ("Emergency", "Critical", "High", "Medium", "Low"):
        text = text.when(severity_col == label, F.lit(RECOMMENDATIONS[label]))
    return text.otherwise(F.lit(RECOMMENDATIONS["Info"]))


def priority(score: Column) -> Column:
    return (
        F.when(score >= 80, F.lit("high"))
        .when(score >= 55, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def packet_vector(
    ip_len: Column,
    ttl: Column,
    proto: Column,
    tcp_flags: Column,
    tcp_payload_len: Column,
    udp_len: Column,
) -> Column:
    """Twelve numbers describing one packet."""

    def share(length: Column) -> Column:
        return F.least(length.cast("double"), F.lit(1500.0)) / 1500.0

    tcp = proto == 6
    udp = proto == 17
    flags = [
        F.when(tcp, F.shiftright(tcp_flags, i).bitwiseAND(1)).otherwise(0).cast("double")
        for i in range(6)
    ]
    last = (
        F.when(tcp, share(tcp_payload_len))
        .when(udp, share(udp_len))
        .otherwise(F.lit(0.0))
    )
    vector = [
        share(ip_len),
        ttl.cast("double") / 255.0,
        tcp.cast("double"),
        udp.cast("double"),
        (~proto.isin(6, 17)).cast("double"),
        *flags,
        last,
    ]
    assert len(vector) == PACKET_FEATURES
    return F.array(*[v.cast("float") for v in vector])


def mean_squared_error(actual: Column, rebuilt: Column) -> Column:
    squares = F.zip_with(actual, rebuilt, lambda a, b: (a - b) * (a - b))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return total / F.size(actual)


def reconstruction_ratio(mse: Column, threshold: Column | float) -> Column:
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    return mse / (limit + F.lit(1e-9))


def softmax(logits: Column) -> Column:
    def shifted(z: Column) -> Column:
        top = F.array_max(z)
        return let(top, lambda t: F.transform(z, lambda v: F.exp(v - t)))

    def shares(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
        return let(total, lambda t: F.transform(exps, lambda e: e / t))

    return let(let(logits, shifted), shares)


def attack_probability(probabilities: Column, classes: Sequence[str]) -> Column:
    """1 − P(BENIGN), or the largest probability when no class is BENIGN."""
    for i, label in enumerate(classes):
        if str(label).upper() == "BENIGN":
            return F.lit(1.0) - probabilities[i]
    return F.array_max(probabilities)


def scaled_bytes(header: Column, width: int) -> Column:
    """Header bytes scaled to 0..1; all zero where a flow has none."""
    scaled = F.transform(header, lambda b: (b.cast("float") / F.lit(255.0)).cast("float"))
    return F.coalesce(scaled, F.array_repeat(F.lit(0.0).cast("float"), width))


def numeric_features(columns: list[str], string_columns: set[str]) -> dict[str, Column]:
    """The feature block as doubles, in one projection."""
    return {c: number_or_zero(name(c), c in string_columns) for c in columns}
