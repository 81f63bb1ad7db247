"""Time buckets and the level-1 traffic flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.functions.cleaning import bucket_micros, is_attack, name
from flowloom.operators.skew import lookup
from flowloom.session import materialize

BUCKET_ROW_BYTES = 16


def bucket_totals(
    flows: DataFrame,
    seconds: int = 60,
    by: list[str] | None = None,
    ts: str = "Timestamp",
    syn: str = "SYN Flag Count",
) -> DataFrame:
    """Sums per non-empty bucket; rows without a time are left out.

    Packets per second are summed where the column exists, rows counted where
    it does not. Null, NaN and infinite values add nothing.
    """
    if "Flow Packets/s" in flows.columns:
        aggs = [_total(flows, "Flow Packets/s").alias("Flow_Packets/s")]
    else:
        aggs = [F.count(F.lit(1)).cast("double").alias("_flow_count")]
    if syn in flows.columns:
        aggs.append(_total(flows, syn).alias("SYN_Flag_Count"))
    return (
        flows.filter(name(ts).isNotNull())
        .groupBy(*(by or []), bucket_micros(name(ts), seconds).alias("bucket"))
        .agg(*aggs)
    )


def _total(flows: DataFrame, column: str) -> Column:
    value = name(column)
    if dict(flows.dtypes)[column] in ("double", "float"):
        value = F.when(F.abs(value) < float("inf"), value)  # NaN sorts above infinity
    return F.coalesce(F.sum(value), F.lit(0)).cast("double")


def dense_buckets(totals: DataFrame, seconds: int = 60) -> DataFrame:
    """Every bucket between the first and the last; empty ones hold zeros.

    The spine is a distributed range, so a long or sparse span does not gather
    in one task.
    """
    step = seconds * 1_000_000
    first, last = totals.agg(F.min("bucket"), F.max("bucket")).first()
    if first is None:
        return totals
    spine = totals.sparkSession.range(first, last + step, step).withColumnRenamed("id", "bucket")
    return spine.join(totals, "bucket", "left").na.fill(0)


def spike_statistics(
    totals: DataFrame, seconds: int, by: list[str] | None = None, value: str = "SYN_Flag_Count"
) -> DataFrame:
    """Mean and sample deviation over all buckets of the span, empty ones as 0.

    The zeros are folded in by the pairwise variance formula, without making
    rows for them.
    """
    step = F.lit(seconds * 1_000_000).cast("double")
    filled = F.count(F.lit(1)).cast("double")
    moments = totals.groupBy(*(by or [])).agg(
        filled.alias("filled"),
        ((F.max("bucket") - F.min("bucket")) / step + 1).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("filled_mean"),
        (F.var_pop(value) * filled).alias("filled_m2"),
    )
    m2 = F.col("filled_m2") + F.col("filled_mean") * F.col("filled_mean") * F.col(
        "filled"
    ) * (F.col("n") - F.col("filled")) / F.col("n")
    return moments.select(
        *(by or []),
        (F.col("total") / F.col("n")).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(m2 / (F.col("n") - 1))).alias("std"),
    )


def spike_flags(
    totals: DataFrame,
    seconds: int,
    multiplier: float = 3.0,
    by: list[str] | None = None,
    value: str = "SYN_Flag_Count",
) -> DataFrame:
    """Buckets with ``l1_syn_spike``: above mean + multiplier · deviation."""
    if value not in totals.columns:
        return totals.withColumn("l1_syn_spike", F.lit(False))
    stats = spike_statistics(totals, seconds, by, value)
    if by:
        rated = lookup(totals, stats, by)
        mean, std = F.col("mean"), F.col("std")
    else:
        rated = totals
        mean, std = stats.select("mean").scalar(), stats.select("std").scalar()
    above = F.col(value) > mean + F.lit(multiplier) * std
    # a span of one bucket has no deviation, and a constant one has zero
    flagged = F.coalesce((std > 0) & above, F.lit(False))
    return rated.withColumn("l1_syn_spike", flagged).drop("mean", "std")


def level1_flags(
    flows: DataFrame,
    seconds: int = 60,
    multiplier: float = 3.0,
    by: list[str] | None = None,
    anomalies: DataFrame | None = None,
    ts: str = "Timestamp",
) -> DataFrame:
    """Flows with ``l1_triggered``: in a spiking or anomalous bucket.

    A flow without a time is triggered, since no bucket can clear it. Only the
    triggered buckets travel to the flows; ``by`` keeps statistics apart per
    chunk or batch. ``anomalies`` holds (``by``, ``bucket``) rows.
    """
    if ts not in flows.columns:
        return flows.withColumn("l1_triggered", F.lit(True))
    by = by or []
    totals = materialize(bucket_totals(flows, seconds, by, ts))
    flagged = (
        spike_flags(totals, seconds, multiplier, by).filter("l1_syn_spike").select(*by, "bucket")
    )
    if anomalies is not None:
        flagged = flagged.unionByName(anomalies.select(*by, "bucket"))
    flagged = flagged.distinct().withColumn("_hit", F.lit(True))
    with_bucket = flows.withColumn("bucket", bucket_micros(name(ts), seconds))
    joined = lookup(with_bucket, flagged, by + ["bucket"], BUCKET_ROW_BYTES)
    return joined.withColumn(
        "l1_triggered", name(ts).isNull() | F.coalesce(F.col("_hit"), F.lit(False))
    ).drop("bucket", "_hit")


def bucket_attack_labels(
    flows: DataFrame, seconds: int = 60, ts: str = "Timestamp", label: str = "Label"
) -> DataFrame:
    """1 for every bucket holding an attack, 0 for the others and empty ones."""
    attack = (
        F.col("is_attack") if "is_attack" in flows.columns else is_attack(name(label))
    )
    per_bucket = (
        flows.filter(name(ts).isNotNull())
        .groupBy(bucket_micros(name(ts), seconds).alias("bucket"))
        .agg(F.max(attack).cast("int").alias("attack"))
    )
    return dense_buckets(per_bucket, seconds)


def training_buckets(
    flows: DataFrame, seconds: int = 60, least: int = 3, ts: str = "Timestamp"
) -> DataFrame | None:
    """Dense numeric bucket table, or None when it has fewer than ``least`` rows."""
    dense = dense_buckets(bucket_totals(flows, seconds, ts=ts), seconds)
    return dense if dense.limit(least).count() >= least else None
