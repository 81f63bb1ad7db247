"""Thresholds, weights and column lists used across the jobs.

Every number a job depends on lives here, so a caller can pass a changed
``Settings`` instead of editing operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: they must equal the published pipeline's for equal results ---

# Columns a prepared flow must have; a missing one aborts the prepare job.
CRITICAL_COLUMNS = ("Source IP", "Label", "Timestamp", "Protocol", "Destination Port")

# Numeric base features of a flow.
BASE_NUMERIC = (
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Fwd Packet Length Max",
    "Fwd Packet Length Min",
    "Fwd Packet Length Mean",
    "Bwd Packet Length Max",
    "Flow Bytes/s",
    "Flow Packets/s",
    "SYN Flag Count",
    "FIN Flag Count",
    "RST Flag Count",
)

HTTP_FEATURES = (
    "http_token_len",
    "http_slash_count",
    "http_non_alnum_ratio",
    "http_flows_same_ip_60s",
    "http_uri_len_roll_std",
    "http_method_hash",
)

DNS_FEATURES = (
    "dns_qname_len",
    "dns_qname_entropy",
    "dns_label_count",
    "dns_max_label_len",
    "dns_digit_ratio",
)

PLAINTEXT_FEATURES = (
    "pcap_dns_qname_len_max",
    "pcap_dns_qname_entropy_max",
    "pcap_http_first_line_len_max",
    "pcap_plaintext_hits",
)

# Flow columns copied to hdr_<name> for the header feature block.
HEADER_SOURCE_COLUMNS = (
    "Flow Duration",
    "Fwd Packet Length Max",
    "Bwd Packet Length Max",
    "Flow Bytes/s",
    "Flow Packets/s",
    "SYN Flag Count",
)

HEADER_FEATURES = tuple("hdr_" + c.replace(" ", "_") for c in HEADER_SOURCE_COLUMNS) + (
    "hdr_flow_fingerprint",
    "hdr_ip_ttl_mean",
    "hdr_tcp_window_max",
)

# Columns of the flow fingerprint, and header features that come from packet tables.
FINGERPRINT_COLUMNS = (
    "Protocol",
    "Destination Port",
    "Source IP",
    "SYN Flag Count",
    "FIN Flag Count",
    "RST Flag Count",
)
PACKET_HEADERS = {"hdr_ip_ttl_mean": "ip_ttl_mean", "hdr_tcp_window_max": "tcp_window_max"}

CONTEXT_COLUMNS = ("Source IP", "Source Port", "http_request_uri", "dns_qname")
CATEGORICAL_COLUMNS = ("Protocol", "Destination Port")

SIEM_TYPES = ("failed_login", "config_change", "new_user")
SEVERITIES = ("Emergency", "Critical", "High", "Medium", "Low", "Info")
INCIDENT_STATES = (
    "new",
    "triaged",
    "in_progress",
    "waiting_approval",
    "closed_true",
    "closed_false",
)

# Score column of each detection channel.
CHANNELS = {
    "rf": "l2_rf_attack_score",
    "ae": "l2_ae_ratio",
    "lstm": "l2_lstm_attack_score",
    "embedding": "l2_emb_attack_score",
    "hdr": "l2_hdr_cnn_attack_score",
    "lstm_pkt": "l2_lstm_pkt_score",
}

PACKETS_PER_FLOW = 16
PACKET_FEATURES = 12
HEADER_PACKETS = 24
HEADER_BYTES = 40
# --- end of fixed values ---


@dataclass(frozen=True)
class Settings:
    """Job parameters with their defaults."""

    bucket_seconds: int = 60
    syn_multiplier: float = 3.0
    gate_on_level1: bool = True
    use_rules: bool = True
    alert_threshold: float = 45.0
    dedup_window_seconds: int = 0
    siem_boost_failed_login: float = 15.0
    siem_boost_config_change: float = 10.0
    window_rows: int = 20
    alert_limit: int = 200
    validation_ratio: float = 0.2
    min_retrain_rows: int = 5000
    accept_equal_f1: bool = True
    bucket_f1_slack: float = 0.05
    max_mse_ratio: float = 1.12
    sequence_f1_slack: float = 0.02
    categorical_accuracy_slack: float = 0.02
    sandbox_min_delta_f1: float = 0.01
    sandbox_min_precision: float = 0.65
    forest_trees: int = 200
    forest_depth: int = 24
    header_depth: int = 24
    categorical_hidden: int = 16
    packet_hidden: int = 24
    fit_iterations: int = 30
    isolation_trees: int = 200
    isolation_sample: int = 256
    contamination: float = 0.02
    encoding_dim: int = 32
    seed: int = 42
    numeric_features: tuple[str, ...] = field(
        default=BASE_NUMERIC
        + HTTP_FEATURES
        + DNS_FEATURES
        + PLAINTEXT_FEATURES
        + HEADER_FEATURES
    )
