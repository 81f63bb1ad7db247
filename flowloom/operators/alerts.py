"""Summaries, series and browsing of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.functions import network, scoring
from flowloom.operators import skew
from flowloom.settings import CHANNELS, SEVERITIES

ZERO = 1e-12
HISTORY_ROWS = 20
REJECTED_ROWS = 5
REJECTED_SHARE = 0.5


def channel_stats(alerts: DataFrame) -> DataFrame:
    """One row per channel: mean, non-zero count, deviation, constant or not.

    All channels are measured in one aggregate and then turned into rows.
    """
    present = {k: c for k, c in CHANNELS.items() if c in alerts.columns}
    aggs = []
    for key, column in present.items():
        v = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        aggs += [
            F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{key}_mean"),
            F.count_if(F.abs(v) > ZERO).alias(f"{key}_nonzero"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{key}_std"),
        ]
    wide = alerts.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("channel"),
                F.round(f"{k}_mean", 6).alias("mean"),
                F.col(f"{k}_nonzero").alias("non_zero_count"),
                F.round(f"{k}_std", 8).alias("std"),
                (F.col(f"{k}_std") > ZERO).alias("is_non_constant"),
                (F.col(f"{k}_nonzero") > 0).alias("used"),
            )
            for k in present
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """One row: count, mean and median score, severity counts, level-1 count.

    Scores carry two decimals, so the exact median's value table is bounded.
    """
    score = F.coalesce(F.col("threat_score"), F.lit(0.0))
    return alerts.agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("threat_score_mean"),
        F.round(F.coalesce(F.median(score), F.lit(0.0)), 4).alias("threat_score_median"),
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s.lower()}") for s in SEVERITIES],
        F.count_if(F.col("l1_triggered")).alias("l1_triggered_true_count"),
    )


def compare_modes(gated: DataFrame, ungated: DataFrame) -> DataFrame:
    """Summaries of both runs side by side, with channel participation checks."""
    out = None
    for mode, alerts in (("default_l1_gated", gated), ("parallel_l2", ungated)):
        stats = channel_stats(alerts)
        used = stats.agg(
            F.max(F.when(F.col("channel") == "rf", F.col("is_non_constant"))).alias("rf_non_constant"),
            F.max(F.when(F.col("channel") == "ae", F.col("used"))).alias("ae_non_zero"),
            F.max(F.when(F.col("channel") == "lstm", F.col("is_non_constant"))).alias(
                "lstm_non_constant"
            ),
        )
        one = alert_summary(alerts).select(F.lit(mode).alias("mode"), "*")
        # both sides are single-row aggregates
        for c in used.columns:
            one = one.withColumn(c, used.select(c).scalar())
        out = one if out is None else out.unionByName(one)
    return out


def with_defaults(alerts: DataFrame) -> DataFrame:
    """Status and severity filled in where the stored alerts lack the column."""
    df = alerts
    if "status" not in df.columns:
        df = df.withColumns({"status": F.lit("new"), "status_defaulted": F.lit(True)})
    else:
        df = df.withColumn("status_defaulted", F.lit(False))
    if "severity" not in df.columns and "threat_score" in df.columns:
        score = F.coalesce(F.col("threat_score").cast("double"), F.lit(0.0))
        df = df.withColumn("severity", scoring.severity(score))
    return df


def browse(
    alerts: DataFrame,
    statuses: list[str] | None = None,
    severities: list[str] | None = None,
    ip_part: str = "",
    min_score: float = 0.0,
) -> DataFrame:
    """Rows matching the filters; an empty filter lets everything through."""
    cond = F.coalesce(F.col("threat_score"), F.lit(0.0)) >= min_score
    if statuses:
        cond = cond & F.col("status").isin(*statuses)
    if severities:
        cond = cond & F.col("severity").isin(*severities)
    if ip_part:
        cond = cond & F.lower("ip").contains(ip_part.lower())
    return alerts.filter(cond)


def filter_options(alerts: DataFrame) -> DataFrame:
    """One row of choices: statuses, severities in canonical order, notes."""
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    sets = alerts.agg(
        F.collect_set("status").alias("s"),
        F.collect_set("severity").alias("v"),
        F.coalesce(F.max("status_defaulted"), F.lit(False)).alias("status_defaulted"),
    )
    severities = F.filter(order, lambda x: F.array_contains(F.col("v"), x))
    return sets.select(
        F.when(F.size("s") > 0, F.array_sort("s")).otherwise(F.array(F.lit("new"))).alias(
            "status_options"
        ),
        severities.alias("severity_options"),
        (F.size(severities) == 1).alias("single_severity"),
        "status_defaulted",
    )


def series_unit(alerts: DataFrame) -> str:
    """``minute`` for spans up to two hours, else ``hour`` (one row is read)."""
    low, high = alerts.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return "hour"
    return "minute" if (high - low).total_seconds() <= 7200 else "hour"


def score_series(alerts: DataFrame, unit: str | None = None) -> DataFrame:
    """Mean threat score per minute or hour; alerts without a time are left out."""
    unit = unit or series_unit(alerts)
    return (
        alerts.filter(F.col("ts").isNotNull())
        .groupBy(F.date_trunc(unit, "ts").alias("slot"))
        .agg(F.avg("threat_score").alias("mean_threat"))
    )


def top_sources(alerts: DataFrame, k: int = 5) -> DataFrame:
    return (
        alerts.groupBy("ip")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy(F.col("alerts").desc(), "ip")
        .limit(k)
    )


def latest_alerts(alerts: DataFrame, k: int = 50) -> DataFrame:
    return alerts.orderBy("alert_seq").limit(k)


def map_positions(alerts: DataFrame, jitter: bool = True, limit: int | None = None) -> DataFrame:
    """Map coordinates; alerts of one address are spread symmetrically."""
    x, y = network.plot_position(F.col("ip"))
    placed = alerts.withColumns({"map_x": x, "map_y": y})
    if not jitter:
        return placed
    ranked = skew.row_positions(placed, ["ip"], ["alert_seq"], "_rank", limit)
    sized = skew.group_counts(ranked, ["ip"], {"dup_size": F.count(F.lit(1))}, limit)
    shift: Column = ((F.col("_rank") - 1) - (F.col("dup_size") - 1) / 2.0) * 0.12
    return sized.withColumns(
        {
            "dup_rank": F.col("_rank") - 1,
            "map_x": F.col("map_x") + shift,
            "map_y": F.col("map_y") + shift,
        }
    ).drop("_rank")


def rejected_share(history: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """Rejections among the latest retrains, and whether to warn."""
    recent = history.orderBy(F.col("ts").desc(), F.col("run_id").desc()).limit(rows)
    counted = recent.agg(
        F.count(F.lit(1)).alias("recent"),
        F.count_if(F.col("result") == "rejected").alias("rejected"),
    )
    warn = (F.col("recent") >= REJECTED_ROWS) & (
        F.col("rejected") / F.greatest(F.col("recent"), F.lit(1)) > REJECTED_SHARE
    )
    return counted.withColumn("warn", warn)
