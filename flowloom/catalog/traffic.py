"""Time-bucket and level-1 queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.base import FLOWS, flows, query
from flowloom.functions.cleaning import is_attack, name
from flowloom.operators import metrics, sampling, traffic

# Hourly buckets: the given events are at most four to a minute.
HOUR = 3600
MULTIPLIER = 2.0

B = 'epoch_us("Timestamp") - epoch_us("Timestamp") % 3600000000'
def bucket_views(where: str = "") -> str:
    return f"""{FLOWS}, totals AS (SELECT {B} AS bucket, sum("Flow Packets/s") AS p,
  sum("SYN Flag Count") AS s, max(("Label" <> 'BENIGN')::INT) AS a FROM flows {where} GROUP BY 1),
dense AS (SELECT g.bucket, coalesce(p, 0)::DOUBLE AS p, coalesce(s, 0)::DOUBLE AS s, coalesce(a, 0) AS a
  FROM (SELECT unnest(generate_series((SELECT min(bucket) FROM totals), (SELECT max(bucket) FROM totals),
    3600000000)) AS bucket) g LEFT JOIN totals USING (bucket)),
spikes AS (SELECT bucket, p, s, a, coalesce(s > (SELECT avg(s) + {MULTIPLIER} * stddev_samp(s) FROM dense),
  false) AS spike FROM dense)"""


BUCKETS = bucket_views()


@query(
    "time_bucket_sums",
    f"""WITH {BUCKETS}
SELECT bucket, round(p, 4) AS packets_per_s, s AS syn FROM dense""",
)
def time_bucket_sums(spark, sf):
    """Dense hourly sums, zeros for the empty hours."""
    dense = traffic.dense_buckets(traffic.bucket_totals(flows(spark, sf), HOUR), HOUR)
    return dense.select(
        "bucket",
        F.round("Flow_Packets/s", 4).alias("packets_per_s"),
        F.col("SYN_Flag_Count").alias("syn"),
    )


@query(
    "minute_bucket_counts",
    f"""WITH {FLOWS}, totals AS (SELECT epoch_us("Timestamp") // 60000000 * 60000000 AS bucket,
  count(*) AS n FROM flows GROUP BY 1)
SELECT g.bucket, coalesce(n, 0)::DOUBLE AS flows FROM (SELECT unnest(generate_series(
  (SELECT min(bucket) FROM totals), (SELECT max(bucket) FROM totals), 60000000)) AS bucket) g
LEFT JOIN totals USING (bucket)""",
)
def minute_bucket_counts(spark, sf):
    """Row counts per minute where the table has no packet rate."""
    bare = flows(spark, sf).select("row_id", "Timestamp")
    dense = traffic.dense_buckets(traffic.bucket_totals(bare, 60), 60)
    return dense.select("bucket", F.col("_flow_count").alias("flows"))


@query(
    "syn_spikes",
    f"WITH {BUCKETS} SELECT bucket, s AS syn, spike AS l1_syn_spike FROM spikes WHERE bucket IN (SELECT bucket FROM totals)",
)
def syn_spikes(spark, sf):
    totals = traffic.bucket_totals(flows(spark, sf), HOUR)
    flagged = traffic.spike_flags(totals, HOUR, MULTIPLIER)
    return flagged.select("bucket", F.col("SYN_Flag_Count").alias("syn"), "l1_syn_spike")


@query(
    "level1_flow_flags",
    f"""WITH {bucket_views("WHERE event_type <> 'view'")}
SELECT row_id, "Source IP" AS ip, CASE WHEN f.event_type = 'view' THEN true
  ELSE coalesce(spike, false) END AS l1_triggered
FROM (SELECT *, {B} AS bucket FROM flows) f LEFT JOIN spikes USING (bucket)""",
)
def level1_flow_flags(spark, sf):
    """Bucket flags back on flows; a flow without a time is triggered."""
    f = flows(spark, sf).withColumn(
        "Timestamp", F.when(F.col("event_type") != "view", F.col("Timestamp"))
    )
    flagged = traffic.level1_flags(f, HOUR, MULTIPLIER)
    return flagged.select("row_id", F.col("Source IP").alias("ip"), "l1_triggered")


@query(
    "level1_spike_or_anomaly",
    f"""WITH {BUCKETS}
SELECT row_id, (spike OR p > 3000) AS l1_triggered
FROM (SELECT *, {B} AS bucket FROM flows) f JOIN spikes USING (bucket)""",
)
def level1_spike_or_anomaly(spark, sf):
    """Level 1 with a given set of anomalous buckets."""
    f = flows(spark, sf)
    anomalies = traffic.bucket_totals(f, HOUR).filter(name("Flow_Packets/s") > 3000)
    return traffic.level1_flags(f, HOUR, MULTIPLIER, anomalies=anomalies).select(
        "row_id", "l1_triggered"
    )


@query(
    "chunked_level1_flags",
    f"""WITH {FLOWS}, c AS (SELECT row_id, row_id // 5000 AS chunk, {B} AS bucket,
  "SYN Flag Count" AS s FROM flows),
totals AS (SELECT chunk, bucket, sum(s) AS s FROM c GROUP BY ALL),
spans AS (SELECT chunk, unnest(generate_series(min(bucket), max(bucket), 3600000000)) AS bucket
  FROM totals GROUP BY chunk),
dense AS (SELECT chunk, bucket, coalesce(s, 0)::DOUBLE AS s FROM spans LEFT JOIN totals USING (chunk, bucket)),
stats AS (SELECT chunk, avg(s) AS m, stddev_samp(s) AS d FROM dense GROUP BY chunk)
SELECT row_id, chunk, coalesce(dense.s > m + {MULTIPLIER} * d, false) AS l1_triggered
FROM c JOIN dense USING (chunk, bucket) JOIN stats USING (chunk)""",
)
def chunked_level1_flags(spark, sf):
    """Chunks of 5,000 rows with statistics of their own, in one job."""
    chunks = sampling.chunk_keys(flows(spark, sf), 5000)
    flagged = traffic.level1_flags(chunks, HOUR, MULTIPLIER, by=["chunk"])
    return flagged.select("row_id", "chunk", "l1_triggered")


@query("bucket_attack_labels", f"WITH {BUCKETS} SELECT bucket, a AS attack FROM dense")
def bucket_attack_labels(spark, sf):
    return traffic.bucket_attack_labels(flows(spark, sf), HOUR).select("bucket", "attack")


@query(
    "training_buckets",
    f"""WITH {BUCKETS} SELECT bucket, round(p, 4) AS packets_per_s, s AS syn FROM dense
WHERE (SELECT count(*) FROM dense) >= 3""",
)
def training_buckets(spark, sf):
    dense = traffic.training_buckets(flows(spark, sf), HOUR)
    return dense.select(
        "bucket",
        F.round("Flow_Packets/s", 4).alias("packets_per_s"),
        F.col("SYN_Flag_Count").alias("syn"),
    )


@query(
    "bucket_alignment_f1",
    f"""WITH {BUCKETS}, c AS (SELECT count(*) FILTER (WHERE spike AND a = 1) AS tp,
  count(*) FILTER (WHERE spike AND a = 0) AS fp, count(*) FILTER (WHERE NOT spike AND a = 1) AS fn,
  count(*) AS n FROM spikes)
SELECT round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, n AS n_used FROM c""",
)
def bucket_alignment_f1(spark, sf):
    """Flagged buckets against buckets holding an attack."""
    f = flows(spark, sf)
    dense = traffic.dense_buckets(traffic.bucket_totals(f, HOUR), HOUR)
    flagged = traffic.spike_flags(dense, HOUR, MULTIPLIER).select(
        "bucket", F.col("l1_syn_spike").cast("int").alias("guess")
    )
    labels = traffic.bucket_attack_labels(f, HOUR)
    joined = flagged.join(labels, "bucket", "left").na.fill({"attack": 0})
    m = metrics.binary_metrics(joined, "attack", "guess")
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return m.select(F.round("f1", 9).alias("f1"), n.alias("n_used"))


@query(
    "detection_metrics",
    f"""WITH {FLOWS}, c AS (SELECT count(*) FILTER (WHERE t = 0 AND g = 0) AS tn,
  count(*) FILTER (WHERE t = 0 AND g = 1) AS fp, count(*) FILTER (WHERE t = 1 AND g = 0) AS fn,
  count(*) FILTER (WHERE t = 1 AND g = 1) AS tp
  FROM (SELECT ("Label" <> 'BENIGN')::INT AS t, (l2_rf_attack_score >= 0.5)::INT AS g FROM flows))
SELECT tn, fp, fn, tp, round((tp + tn)::DOUBLE / (tn + fp + fn + tp), 9) AS accuracy,
  round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 9) AS fpr,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""",
)
def detection_metrics(spark, sf):
    guess = flows(spark, sf).select(
        is_attack(F.col("Label")).alias("t"),
        (F.col("l2_rf_attack_score") >= 0.5).cast("int").alias("g"),
    )
    m = metrics.binary_metrics(guess, "t", "g")
    rounded = ("accuracy", "fpr", "precision", "recall", "f1")
    return m.select("tn", "fp", "fn", "tp", *[F.round(c, 9).alias(c) for c in rounded])


@query(
    "class_report",
    """
WITH p AS (SELECT event_type AS t, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS g FROM events),
k AS (SELECT t AS label FROM p UNION SELECT g FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE t = label) AS support,
  (SELECT count(*) FROM p WHERE g = label) AS guessed,
  (SELECT count(*) FROM p WHERE g = label AND t = label) AS hits FROM k),
s AS (SELECT label, coalesce(hits::DOUBLE / nullif(guessed, 0), 0) AS precision,
  coalesce(hits::DOUBLE / nullif(support, 0), 0) AS recall,
  coalesce(2.0 * hits / nullif(guessed + support, 0), 0) AS f1, support FROM c)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  support::BIGINT AS support FROM s
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
  sum(support)::BIGINT FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
  round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
  sum(support)::BIGINT FROM s""",
)
def class_report(spark, sf):
    from flowloom.catalog.base import table

    d = table(spark, sf, "events").select(
        F.col("event_type").alias("t"),
        F.when(F.col("event_id") % 3 == 0, "view").otherwise(F.col("event_type")).alias("g"),
    )
    return metrics.class_report(d, "t", "g").select(
        "label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


DIRTY = 'CASE WHEN row_id % 11 IN (0, 3, 7) THEN 0 ELSE "SYN Flag Count" END'


@query(
    "level1_dirty_values",
    f"""WITH {FLOWS}, totals AS (SELECT {B} AS bucket, sum({DIRTY})::DOUBLE AS s FROM flows GROUP BY 1),
dense AS (SELECT g.bucket, coalesce(s, 0) AS s FROM (SELECT unnest(generate_series((SELECT min(bucket) FROM totals),
  (SELECT max(bucket) FROM totals), 3600000000)) AS bucket) g LEFT JOIN totals USING (bucket))
SELECT bucket, s AS syn, s > (SELECT avg(s) + {MULTIPLIER} * stddev_samp(s) FROM dense) AS l1_syn_spike
FROM dense WHERE bucket IN (SELECT bucket FROM totals)""",
)
def level1_dirty_values(spark, sf):
    """Spikes found although SYN counts hold NaN, infinities and nulls."""
    k = F.col("row_id") % 11
    syn = (
        F.when(k == 0, F.lit(float("nan"))).when(k == 3, F.lit(float("inf")))
        .when(k != 7, F.col("SYN Flag Count").cast("double"))
    )
    totals = traffic.bucket_totals(flows(spark, sf).withColumn("SYN Flag Count", syn), HOUR)
    flagged = traffic.spike_flags(totals, HOUR, MULTIPLIER)
    return flagged.select("bucket", F.col("SYN_Flag_Count").alias("syn"), "l1_syn_spike")
