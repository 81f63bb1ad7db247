"""Detection job: scored flows to graded, suppressed alerts."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.functions import scoring
from flowloom.functions.cleaning import name
from flowloom.operators.correlation import join_locations, join_siem, siem_counts
from flowloom.operators.skew import lookup
from flowloom.operators.suppression import suppress
from flowloom.operators.traffic import level1_flags
from flowloom.session import materialize
from flowloom.settings import CHANNELS, Settings

SYNTHETIC_SOURCES = 250


def with_channels(flows: DataFrame) -> DataFrame:
    """Every channel column present: absent models score 0."""
    absent = {c: F.lit(0.0) for c in CHANNELS.values() if c not in flows.columns}
    return flows.withColumns(absent) if absent else flows


def gate_scores(flows: DataFrame, gate: bool) -> DataFrame:
    """Scores count only where level 1 triggered, when gating is on."""
    if not gate:
        return flows
    return flows.withColumns(
        {
            c: F.when(F.col("l1_triggered"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
            for c in CHANNELS.values()
        }
    )


def join_scores(flows: DataFrame, scores: DataFrame, column: str, order: str = "seq") -> DataFrame:
    """Scores kept per flow key in a table of their own; the last one of a key wins."""
    last = scores.groupBy("flow_key").agg(F.max_by("score", order).alias("_score"))
    joined = lookup(flows, materialize(last), ["flow_key"], row_bytes=128)
    return joined.withColumn(column, F.coalesce(F.col("_score"), F.lit(0.0))).drop("_score")


def source_address(columns: list[str]) -> Column:
    if "Source IP" in columns:
        return name("Source IP").cast("string")
    return F.concat(F.lit("10.0.0."), (F.col("row_id") % SYNTHETIC_SOURCES).cast("string"))


def cascade(
    flows: DataFrame, cfg: Settings, by: list[str] | None = None, anomalies: DataFrame | None = None
) -> DataFrame:
    """Level 1, then the gated channel scores; the schema is always complete."""
    flagged = (
        flows
        if "l1_triggered" in flows.columns
        else level1_flags(flows, cfg.bucket_seconds, cfg.syn_multiplier, by, anomalies)
    )
    return gate_scores(with_channels(flagged), cfg.gate_on_level1)


def detect(
    flows: DataFrame,
    cfg: Settings | None = None,
    siem: DataFrame | None = None,
    geo: DataFrame | None = None,
    demo: bool = False,
    by: list[str] | None = None,
    anomalies: DataFrame | None = None,
    now: dt.datetime | None = None,
    group_limit: int | None = None,
) -> DataFrame:
    """Alerts of scored flows; ``alert_seq`` is the flow's ``row_id``.

    The order of the steps matters: rules raise the score but do not make an
    alert, and the score threshold comes before suppression, so an alert below
    it never silences a later one. ``demo`` alerts on every flow, ungated and
    without a threshold.
    """
    cfg = cfg or Settings()
    if demo:
        cfg = replace(cfg, gate_on_level1=False, alert_threshold=0.0)
    scored = cascade(flows, cfg, by, anomalies)
    columns = scored.columns
    rules = scoring.rule_conditions(dict(scored.dtypes)) if cfg.use_rules else {}
    names = scoring.rule_names(rules) if rules else F.array().cast("array<string>")
    picked = scored if demo else scored.filter(scoring.alert_predicate(cfg.gate_on_level1))
    fused = picked.select(
        F.col("row_id").alias("alert_seq"),
        *(by or []),
        source_address(columns).alias("ip"),
        (name("Destination IP") if "Destination IP" in columns else F.lit("")).alias("dst_ip"),
        (name("Timestamp") if "Timestamp" in columns else F.lit(None).cast("timestamp")).alias("ts"),
        "l1_triggered",
        *CHANNELS.values(),
        scoring.network_score().alias("network_score"),
        names.alias("triggered_rules"),
        F.least(
            F.lit(1.0),
            F.greatest(F.lit(0.0), scoring.network_score() + scoring.rule_boost(rules)),
        ).alias("network_score_with_rules"),
    )
    counts = None if siem is None else materialize(siem_counts(siem))
    if counts is not None and not counts.isEmpty():
        graded = _grade_with_siem(join_siem(fused, counts), cfg)
    else:
        graded = _grade_alone(fused, cfg)
    alerts = graded.filter(F.col("threat_score") >= cfg.alert_threshold)
    if geo is not None:
        alerts = join_locations(alerts, geo)
    else:
        null = F.lit(None).cast("double")
        alerts = alerts.withColumns({"latitude": null, "longitude": null})
    alerts = assemble(alerts, by or [])
    if cfg.dedup_window_seconds > 0:
        group = ("ip", "severity", *(by or []))
        # the scan reads the alerts several times: do not detect again each time
        alerts = suppress(materialize(alerts), cfg.dedup_window_seconds, group, now=now, limit=group_limit)
    return alerts


def _grade_with_siem(df: DataFrame, cfg: Settings) -> DataFrame:
    """The band is read off the score before it is rounded."""
    raw = scoring.threat_score_raw(
        F.col("network_score_with_rules"), F.col("failed_login"), F.col("config_change"), cfg
    )
    signal = (F.col("failed_login") > 0) | (F.col("config_change") > 0)
    graded = df.withColumn("_raw", raw).withColumn("severity", scoring.severity(F.col("_raw")))
    return graded.withColumns(
        {
            "threat_score": F.round("_raw", 2),
            "recommendation": scoring.recommendation(F.col("severity"), signal),
            "siem_failed_login": F.col("failed_login").cast("long"),
            "siem_config_change": F.col("config_change").cast("long"),
        }
    ).drop("_raw")


def _grade_alone(df: DataFrame, cfg: Settings) -> DataFrame:
    """Without SIEM events the band is read off the rounded score."""
    score = F.round(100 * F.least(F.col("network_score_with_rules"), F.lit(1.0)), 2)
    graded = df.withColumn("threat_score", score)
    return graded.withColumns(
        {
            "severity": scoring.severity(F.col("threat_score")),
            "recommendation": F.lit(scoring.RECOMMENDATIONS["no_siem"]),
            "siem_failed_login": F.lit(None).cast("long"),
            "siem_config_change": F.lit(None).cast("long"),
        }
    )


def assemble(df: DataFrame, by: list[str]) -> DataFrame:
    """The alert record."""
    return df.select(
        "alert_seq",
        *by,
        "ip",
        "ts",
        "threat_score",
        "severity",
        "recommendation",
        "siem_failed_login",
        "siem_config_change",
        F.lit("new").alias("status"),
        "l1_triggered",
        *[F.round(c, 4).alias(c) for c in CHANNELS.values()],
        F.struct(
            F.round("network_score", 6).alias("network_score"),
            F.round("network_score_with_rules", 6).alias("network_score_with_rules"),
        ).alias("model_signals"),
        "triggered_rules",
        F.when(F.size("triggered_rules") > 0, "rule+ml fusion").otherwise("ml-only").alias("reason"),
        "latitude",
        "longitude",
    )
