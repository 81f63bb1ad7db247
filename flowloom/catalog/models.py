"""Model queries: windows, isolation forests, channels, retraining."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from flowloom.catalog.base import FLOWS, flows, packets, query, table
from flowloom.catalog.traffic import HOUR, MULTIPLIER
from flowloom.functions.cleaning import is_attack
from flowloom.operators import isolation, metrics, models, traffic
from flowloom.operators import packets as packet_ops
from flowloom.operators.features import with_flow_key
from flowloom.operators.skew import exact_quantile
from flowloom.session import materialize, scratch_path
from flowloom.settings import BASE_NUMERIC, Settings

FEATURES = list(BASE_NUMERIC)
CFG = Settings(bucket_seconds=HOUR, syn_multiplier=MULTIPLIER)


def labelled(spark, sf):
    f = flows(spark, sf)
    return f.withColumn("is_attack", is_attack(F.col("Label")))


def evaluated(df, score: str, cut: float):
    """Metrics of a score against the label."""
    guess = df.select("is_attack", (F.col(score) >= cut).cast("int").alias("g"))
    return metrics.binary_metrics(guess, "is_attack", "g")


@query(
    "global_sequence_windows",
    f"""WITH {FLOWS}, w AS (SELECT row_id, count(*) OVER v AS n, sum("Flow Packets/s") OVER v AS s, first("SYN Flag Count") OVER v AS f
  FROM flows WINDOW v AS (ORDER BY "Timestamp", row_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT row_id, CASE WHEN n = 20 THEN 20 END AS rows, CASE WHEN n = 20 THEN round(s, 4) END AS total,
  CASE WHEN n = 20 THEN f::DOUBLE END AS first_syn FROM w""",
)
def global_sequence_windows(spark, sf):
    """Windows of twenty consecutive rows of the whole table."""
    w = models.sequence_windows(
        flows(spark, sf).select("row_id", "Timestamp", "Flow Packets/s", "SYN Flag Count"),
        ["Flow Packets/s", "SYN Flag Count"],
        20,
    )
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0])
    return w.select(
        "row_id",
        F.when(F.col("window").isNotNull(), F.size("window")).alias("rows"),
        F.round(total, 4).alias("total"),
        F.col("window")[0][1].alias("first_syn"),
    )


@query(
    "source_sequence_windows",
    f"""WITH {FLOWS}, w AS (SELECT row_id, count(*) OVER v AS n, sum("Flow Packets/s") OVER v AS s FROM flows
  WINDOW v AS (PARTITION BY "Source IP" ORDER BY "Timestamp", row_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT row_id, CASE WHEN n = 5 THEN round(s, 4) END AS total FROM w""",
)
def source_sequence_windows(spark, sf):
    """Windows kept inside each source."""
    w = models.sequence_windows(
        flows(spark, sf).select("row_id", "Timestamp", "Source IP", "Flow Packets/s"),
        ["Flow Packets/s"],
        5,
        ["Source IP"],
    )
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0])
    return w.select("row_id", F.round(total, 4).alias("total"))


@query(
    "error_threshold",
    """SELECT round(quantile_cont(d, 0.95), 9) AS threshold FROM (SELECT list_sum(list_transform(embedding,
  lambda x: x::DOUBLE * x::DOUBLE)) + len(embedding) * label AS d FROM embeddings)""",
)
def error_threshold(spark, sf):
    """Exact 95th percentile of a per-row value."""
    a = F.col("embedding").cast("array<double>")
    size = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) + F.size(a) * F.col("label")
    d = table(spark, sf, "embeddings").select(size.alias("d"))
    cut = exact_quantile(d, "d", 0.95)
    return d.agg(F.round(F.lit(cut), 9).alias("threshold"))


@query("isolation_forest_flows")
def isolation_forest_flows(spark, sf):
    """Anomaly flags of flows; about two percent by construction."""
    f = labelled(spark, sf)
    model = isolation.fit(f, FEATURES, trees=CFG.isolation_trees)
    flagged = model.flag(f)
    return flagged.select("row_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("isolation_forest_buckets")
def isolation_forest_buckets(spark, sf):
    """Level-1 flags with anomalous traffic buckets besides the spikes."""
    f = labelled(spark, sf)
    buckets = traffic.training_buckets(f, HOUR)
    model = isolation.fit(
        buckets, ["Flow_Packets/s", "SYN_Flag_Count"], key="bucket", trees=CFG.isolation_trees
    )
    anomalies = model.flag(buckets).filter("is_anomaly").select("bucket")
    flagged = traffic.level1_flags(f, HOUR, MULTIPLIER, anomalies=anomalies)
    return flagged.select("row_id", "l1_triggered")


@query("forest_channel")
def forest_channel(spark, sf):
    f = labelled(spark, sf)
    scored = models.fit_forest(f, FEATURES, CFG).score(f)
    return scored.select("row_id", F.round("l2_rf_attack_score", 6).alias("l2_rf_attack_score"))


@query(
    "forest_properties",
    """SELECT event_id AS row_id, true AS in_range, true AS same_after_load, true AS above_majority, 200 AS trees
FROM events""",
)
def forest_properties(spark, sf):
    """Every row is scored once between 0 and 1, alike by the saved forest; F1 is above that of either constant guess."""
    f = labelled(spark, sf)
    ch = models.fit_forest(f, FEATURES, CFG)
    path = scratch_path(spark, "forest")
    ch.save(path)
    again = models.Channel.load(spark, path)
    again.out = "loaded"
    scored = again.score(ch.score(f.select("row_id", "is_attack", *[F.col(f"`{c}`") for c in FEATURES])))
    base = f.agg(F.avg("is_attack").alias("p"))
    always = base.select((2 * F.col("p") / (1 + F.col("p"))).alias("f1")).scalar()
    f1 = evaluated(scored, ch.out, 0.5).select("f1").scalar()
    s = F.col(ch.out)
    return scored.select(
        "row_id", s.between(0, 1).alias("in_range"), (s == F.col("loaded")).alias("same_after_load"),
        (f1 > always).alias("above_majority"), F.lit(again.pipeline.count()).alias("trees"),
    )


@query("reconstruction_channel")
def reconstruction_channel(spark, sf):
    f = labelled(spark, sf)
    scored = models.fit_reconstruction(f, FEATURES, CFG).score(f)
    return scored.select("row_id", F.round("l2_ae_ratio", 6).alias("l2_ae_ratio"))


@query("vector_reconstruction_errors")
def vector_reconstruction_errors(spark, sf):
    """The same channel on the given vectors, benign being label 0."""
    e = table(spark, sf, "embeddings")
    width = len(e.first()["embedding"])
    wide = e.select(
        "vec_id",
        (F.col("label") > 0).cast("int").alias("is_attack"),
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(width)],
    )
    features = [f"x{i}" for i in range(width)]
    ch = models.fit_reconstruction(wide, features, CFG)
    return ch.score(wide).select("vec_id", F.round("l2_ae_ratio", 6).alias("l2_ae_ratio"))


@query("sequence_channel")
def sequence_channel(spark, sf):
    f = labelled(spark, sf)
    ch = models.fit_sequence(f, ["Flow Packets/s", "SYN Flag Count", "RST Flag Count"], CFG)
    return ch.score(f).select("row_id", F.round("l2_lstm_attack_score", 6).alias("l2_lstm_attack_score"))


@query("categorical_channel")
def categorical_channel(spark, sf):
    f = labelled(spark, sf)
    scored = models.fit_categorical(f, FEATURES, CFG).score(f)
    return scored.select("row_id", F.round("l2_emb_attack_score", 6).alias("l2_emb_attack_score"))


def packet_labelled(spark, sf):
    p = packets(spark, sf)
    f = with_flow_key(packet_ops.packet_flows(p))
    return p, f.withColumn("is_attack", (F.col("RST Flag Count") > 0).cast("int"))


@query("header_channel")
def header_channel(spark, sf):
    p, f = packet_labelled(spark, sf)
    rows = packet_ops.join_header_bytes(f, packet_ops.header_blocks(p))
    ch = models.fit_header(rows, CFG)
    return ch.score(rows).select("flow_key", F.round("l2_hdr_cnn_attack_score", 6).alias("score"))


@query("packet_channel")
def packet_channel(spark, sf):
    p, f = packet_labelled(spark, sf)
    # aggregated and joined once, and kept short: the fit and the scores read these rows
    f = materialize(f.select("flow_key", "is_attack"), coalesced=False)
    rows = packet_ops.join_sequences(f, packet_ops.packet_sequences(p, padded=False), padded=False)
    rows = materialize(rows, coalesced=False)
    ch = models.fit_packets(rows, CFG)
    return ch.score(rows).select("flow_key", F.round("l2_lstm_pkt_score", 6).alias("score"))


@query("cascade_with_models")
def cascade_with_models(spark, sf):
    """Level 1, then fitted channels on the triggered rows, then alerts."""
    from flowloom.plans.detect import detect

    f = labelled(spark, sf).drop(*[c for c in flows(spark, sf).columns if c.startswith("l2_")])
    channels = [models.fit_forest(f, FEATURES, CFG), models.fit_reconstruction(f, FEATURES, CFG)]
    flagged = traffic.level1_flags(f, HOUR, MULTIPLIER)
    scored = models.score_channels(flagged, channels, gate=True)
    return detect(scored, replace(CFG, alert_threshold=0.0)).select(
        "alert_seq", "ip", "threat_score", "severity"
    )


@query("retrain_iteration")
def retrain_iteration(spark, sf):
    """One guarded retrain over the whole buffer; its history row."""
    from flowloom.plans.retrain import retrain_once
    cfg = replace(CFG, min_retrain_rows=1000)
    report = retrain_once(labelled(spark, sf), scratch_path(spark, "retrain"), FEATURES, cfg)
    return report.select("result", "reason", "input_rows", F.round("if_f1", 6).alias("if_f1"))
