"""Upserts, incidents, gates and histories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from flowloom.catalog.alerts import BAND, alerts_sql, open_alerts
from flowloom.catalog.base import FLOWS, flows, query, table
from flowloom.functions.cleaning import micros, name
from flowloom.functions.text import row_fingerprint
from flowloom.operators import alerts as alert_ops
from flowloom.operators import governance as ops
from flowloom.operators import metrics
from flowloom.session import materialize
from flowloom.settings import Settings
from flowloom.sources import lines, sinks

NOW = dt.datetime(2024, 7, 1, 12)
CFG = Settings()

# Two overlapping slices of orders; the second repeats keys with new prices.
UPSERT_VIEWS = """old AS (SELECT o_orderkey AS seq, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'k' || o_orderkey END AS k,
  o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT o_orderkey * 2 AS seq, 'k' || o_orderkey AS k, o_totalprice + 1 AS price FROM orders WHERE o_orderpriority < '4'
  UNION ALL SELECT o_orderkey * 2 + 1, 'k' || o_orderkey, o_totalprice + 2 FROM orders WHERE o_orderpriority < '2')"""


def upsert_sides(spark, sf):
    o = table(spark, sf, "orders")
    k = F.concat(F.lit("k"), F.col("o_orderkey"))
    old = o.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(k).alias("k"),
        F.col("o_totalprice").alias("price"),
    )
    new = o.filter("o_orderpriority < '4'").select(
        (F.col("o_orderkey") * 2).alias("seq"), k.alias("k"), (F.col("o_totalprice") + 1).alias("price")
    )
    again = o.filter("o_orderpriority < '2'").select(
        (F.col("o_orderkey") * 2 + 1).alias("seq"), k.alias("k"), (F.col("o_totalprice") + 2).alias("price")
    )
    return old, new.unionByName(again)


@query(
    "upserted_rows",
    f"""WITH {UPSERT_VIEWS}, b AS (SELECT 0 AS b, * FROM old WHERE k <> '' UNION ALL SELECT 1, * FROM new),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b DESC, seq DESC) AS n,
  first_value(b) OVER (PARTITION BY k ORDER BY b, seq) AS fb, first_value(seq) OVER (PARTITION BY k ORDER BY b, seq) AS fs FROM b)
SELECT k, seq, round(price, 2) AS price, fb AS first_batch, fs AS first_seq FROM r WHERE n = 1""",
)
def upserted_rows(spark, sf):
    """Last write wins, first position kept, empty keys dropped."""
    merged, _ = ops.upsert(*upsert_sides(spark, sf), "k")
    return merged.select(
        "k",
        "seq",
        F.round("price", 2).alias("price"),
        F.col("position.b").alias("first_batch"),
        F.col("position.o").alias("first_seq"),
    )


@query(
    "upsert_counts",
    f"""WITH {UPSERT_VIEWS}, fresh AS (SELECT count(DISTINCT k) AS i FROM new WHERE k NOT IN (SELECT k FROM old WHERE k <> ''))
SELECT i AS inserted, (SELECT count(*) FROM new) - i AS updated FROM fresh""",
)
def upsert_counts(spark, sf):
    return ops.upsert(*upsert_sides(spark, sf), "k")[1]


@query(
    "last_row_per_key",
    """SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, round(arg_max(o_totalprice, o_orderkey), 2) AS price
FROM orders GROUP BY o_custkey""",
)
def last_row_per_key(spark, sf):
    last = ops.last_by_key(table(spark, sf, "orders"), "o_custkey", "o_orderkey")
    return last.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query(
    "distinct_incident_rows",
    "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders",
)
def distinct_incident_rows(spark, sf):
    """Repeated rows are removed before a join."""
    return table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


HASH = """sha1(concat('{"alert_seq":', alert_seq, ',"ip":"', ip, '","severity":"', severity, '"}'))"""


@query(
    "alert_identities",
    f"WITH {alerts_sql(False, True)} SELECT alert_seq, {HASH} AS hash, concat('inc_', substr({HASH}, 1, 12)) AS incident_id FROM alerts",
)
def alert_identities(spark, sf):
    """SHA-1 of the alert's canonical JSON and the incident id made of it."""
    from flowloom.functions.text import alert_hash, incident_id

    a = open_alerts(spark, sf).select("alert_seq", "ip", "severity")
    hashed = a.withColumn("hash", alert_hash(a.columns))
    return hashed.select("alert_seq", "hash", incident_id(F.col("hash")).alias("incident_id"))


_INC = f"""a AS (SELECT alert_seq, ip, severity, {HASH} AS h FROM alerts),
old AS (SELECT concat('inc_', substr(h, 1, 12)) AS incident_id, alert_seq FROM a WHERE severity = 'Emergency')"""


def _known_and_alerts(spark, sf):
    a = materialize(open_alerts(spark, sf).select("alert_seq", "ip", "severity"))
    known = ops.incidents_from_alerts(a.filter("severity = 'Emergency'"), dt.datetime(2024, 1, 1))
    return known.withColumns({"status": F.lit("triaged"), "owner": F.lit("ann")}), a


@query(
    "incidents_synced",
    f"""WITH {alerts_sql(False, True)}, {_INC}
SELECT concat('inc_', substr(h, 1, 12)) AS incident_id, ip, CASE WHEN severity = 'Emergency' THEN 'triaged' ELSE 'new' END AS status,
  CASE WHEN severity = 'Emergency' THEN 'ann' END AS owner,
  CASE WHEN severity = 'Emergency' THEN epoch_us(TIMESTAMP '2024-01-01') ELSE epoch_us(TIMESTAMP '2024-07-01 12:00:00') END AS created,
  epoch_us(TIMESTAMP '2024-07-01 12:00:00') AS updated, severity = 'Emergency' AS known FROM a""",
)
def incidents_synced(spark, sf):
    """Alerts upserted into incidents; known ones keep their workflow fields."""
    known, a = _known_and_alerts(spark, sf)
    merged, _ = ops.sync_incidents(known, a, NOW)
    return merged.select(
        "incident_id",
        "ip",
        "status",
        "owner",
        micros(F.col("created_at")).alias("created"),
        micros(F.col("updated_at")).alias("updated"),
        (F.col("position.b") == 0).alias("known"),
    )


@query(
    "incidents_replaced",
    f"""WITH {alerts_sql(False, True)}, {_INC}
SELECT concat('inc_', substr(h, 1, 12)) AS incident_id, 'new' AS status, NULL::VARCHAR AS owner,
  'low' AS priority FROM a""",
)
def incidents_replaced(spark, sf):
    """The same sync with whole-row replacement: workflow fields are reset."""
    known, a = _known_and_alerts(spark, sf)
    merged, _ = ops.sync_incidents(known, a, NOW, replace_workflow=True)
    return merged.select("incident_id", "status", "owner", "priority")


@query(
    "incident_cards",
    f"""WITH {alerts_sql(False, True)} SELECT alert_seq, ip, threat_score, 'new' AS status,
  CASE WHEN threat_score >= 80 THEN 'high' WHEN threat_score >= 55 THEN 'medium' ELSE 'low' END AS priority,
  siem_failed_login, siem_config_change, l1_triggered, l2_rf_attack_score, l2_emb_attack_score FROM alerts""",
)
def incident_cards(spark, sf):
    """Incidents of full alerts as flat export rows."""
    incidents = materialize(ops.incidents_from_alerts(open_alerts(spark, sf), NOW))
    cards = sinks.incident_cards(incidents)
    keyed = incidents.select("incident_id", "alert_seq").join(cards, "incident_id")
    return keyed.select(
        "alert_seq",
        "ip",
        "threat_score",
        "status",
        "priority",
        "siem_failed_login",
        "siem_config_change",
        "l1_triggered",
        "l2_rf_attack_score",
        "l2_emb_attack_score",
    )


# Status changes: one per order, for the incident of its customer.
STATES = "['new', 'triaged', 'in_progress', 'closed_true', 'bogus']"
CHANGES = f"""inc AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN 'triaged' ELSE 'new' END AS status FROM customer WHERE c_acctbal > 0),
ch AS (SELECT o_custkey AS id, o_orderkey AS seq, {STATES}[1 + o_orderkey % 5] AS status,
  CASE WHEN o_orderpriority < '2' THEN 'o' || o_orderkey ELSE '' END AS owner FROM orders),
ok AS (SELECT ch.*, inc.status AS was FROM ch JOIN inc USING (id) WHERE ch.status <> 'bogus')"""


def change_tables(spark, sf):
    inc = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("incident_id"),
        F.when(F.col("c_nationkey") < 5, "triaged").otherwise("new").alias("status"),
        F.lit(None).cast("string").alias("owner"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp").alias("updated_at"),
    )
    states = F.array(*[F.lit(s) for s in ("new", "triaged", "in_progress", "closed_true", "bogus")])
    ch = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("incident_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.get(states, (F.col("o_orderkey") % 5).cast("int")).alias("status"),
        F.when(F.col("o_orderpriority") < "2", F.concat(F.lit("o"), F.col("o_orderkey")))
        .otherwise("")
        .alias("owner"),
        F.lit("").alias("comment"),
        F.lit("ann").alias("actor"),
    )
    return inc, ch


@query(
    "incident_status_changes",
    f"""WITH {CHANGES}, f AS (SELECT id, arg_max(status, seq) AS s, arg_max(owner, seq) FILTER (WHERE owner <> '') AS o FROM ok GROUP BY id)
SELECT inc.id::VARCHAR AS incident_id, coalesce(s, inc.status) AS status, o AS owner FROM inc LEFT JOIN f USING (id)""",
)
def incident_status_changes(spark, sf):
    """Incidents after a batch of changes."""
    updated, _, _ = ops.change_status(*change_tables(spark, sf))
    return updated.select("incident_id", "status", "owner")


@query(
    "incident_action_log",
    f"""WITH {CHANGES} SELECT concat('act_', seq) AS action_id, id::VARCHAR AS incident_id,
  coalesce(lag(status) OVER (PARTITION BY id ORDER BY seq), was) AS old_value, status AS new_value FROM ok""",
)
def incident_action_log(spark, sf):
    """Audit rows: each change with the value it replaced."""
    _, audit, _ = ops.change_status(*change_tables(spark, sf))
    return audit.select("action_id", "incident_id", "old_value", "new_value")


@query(
    "refused_status_changes",
    f"""WITH {CHANGES} SELECT seq, CASE WHEN ch.status = 'bogus' THEN 'unknown status' ELSE 'unknown incident' END AS reason
FROM ch LEFT JOIN inc USING (id) WHERE ch.status = 'bogus' OR inc.id IS NULL""",
)
def refused_status_changes(spark, sf):
    _, _, refused = ops.change_status(*change_tables(spark, sf))
    return refused.select("seq", "reason")


@query(
    "action_history",
    f"""WITH {CHANGES} SELECT seq, status AS new_value FROM ok WHERE id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def action_history(spark, sf):
    """Audit rows of the incidents a user looks at."""
    _, audit, _ = ops.change_status(*change_tables(spark, sf))
    chosen = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("incident_id")
    )
    return ops.action_history(audit, chosen).select(
        F.expr("CAST(substring(action_id, 5) AS BIGINT)").alias("seq"), "new_value"
    )


@query(
    "alerts_with_incidents",
    f"""WITH {alerts_sql(False, True)}, i AS (SELECT DISTINCT ip, ts, round(threat_score * 100)::BIGINT AS cents,
  'inc' || alert_seq AS incident_id, CASE WHEN threat_score >= 90 THEN 'triaged' END AS status FROM alerts WHERE severity <> 'Medium')
SELECT alert_seq, incident_id, coalesce(i.status, 'new') AS status FROM alerts a
LEFT JOIN i ON a.ip = i.ip AND a.ts IS NOT DISTINCT FROM i.ts AND round(a.threat_score * 100)::BIGINT = i.cents""",
)
def alerts_with_incidents(spark, sf):
    """Incident status over alert status, joined on address, time and score."""
    a = materialize(
        open_alerts(spark, sf).select("alert_seq", "ip", "ts", "threat_score", "severity", "status")
    )
    incidents = a.filter("severity <> 'Medium'").select(
        F.concat(F.lit("inc"), F.col("alert_seq")).alias("incident_id"),
        "ip",
        "ts",
        "threat_score",
        F.when(F.col("threat_score") >= 90, "triaged").alias("status"),
    )
    doubled = incidents.unionByName(incidents)
    return ops.join_incidents(a, doubled).select("alert_seq", "incident_id", "status")


@query(
    "labels_imported",
    """WITH old AS (SELECT 's' || doc_id AS sample_id, toxic AS is_attack, 'first' AS src, 0 AS b, doc_id AS seq FROM labels WHERE quality = 1),
new AS (SELECT CASE WHEN toxic = 1 THEN 'smp_import_' || doc_id ELSE 's' || doc_id END, quality, 'imported', 1, doc_id FROM labels),
u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT sample_id, arg_max(is_attack, b) AS is_attack, arg_max(src, b) AS label_source, count(*) FILTER (WHERE b = 1) > 0 AS written
FROM u GROUP BY sample_id""",
)
def labels_imported(spark, sf):
    """Labelled samples upserted; blank sample ids are generated."""
    d = table(spark, sf, "labels")
    sid = F.concat(F.lit("s"), F.col("doc_id"))
    old = d.filter("quality = 1").select(
        sid.alias("sample_id"),
        F.col("toxic").alias("is_attack"),
        F.lit("first").alias("label_source"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp").alias("imported_at"),
        F.col("doc_id").alias("seq"),
    )
    new = d.select(
        F.when(F.col("toxic") == 1, " ").otherwise(sid).alias("sample_id"),
        F.col("quality").alias("is_attack"),
        F.col("doc_id").alias("seq"),
    )
    merged, _ = ops.import_labels(old, new, "imported", NOW)
    return merged.select(
        "sample_id", "is_attack", "label_source", (F.year("imported_at") * 100 + F.month("imported_at") == 202407).alias("written")
    )


@query(
    "heterogeneous_rows",
    """SELECT count(*) AS rows, count(c_custkey) AS customers, count(s_suppkey) AS suppliers, 2 AS first_columns
FROM (SELECT c_custkey, NULL AS s_suppkey FROM customer UNION ALL SELECT NULL, s_suppkey FROM supplier)""",
)
def heterogeneous_rows(spark, sf):
    """Union of tables with different columns under sorted names."""
    u = ops.union_columns([table(spark, sf, "customer"), table(spark, sf, "supplier")])
    lead = [c for c in u.columns if c <= "c_custkey"]
    return u.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("c_custkey").alias("customers"),
        F.count("s_suppkey").alias("suppliers"),
        F.lit(len(lead)).alias("first_columns"),
    )


@query(
    "row_tables_from_lines",
    """SELECT o_custkey AS incident_id, count(*) AS n, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS malformed
FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1""",
)
def row_tables_from_lines(spark, sf):
    """A row table kept as JSON lines, with its count of malformed lines."""
    from pyspark.sql import types as T

    good = F.to_json(F.struct(F.col("o_custkey").alias("incident_id"), F.col("o_orderstatus").alias("status")))
    value = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(good, F.lit("}")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("[]"))
        .otherwise(good)
    )
    schema = T.StructType(
        [T.StructField("incident_id", T.LongType()), T.StructField("status", T.StringType())]
    )
    rows, bad = lines.load_rows(table(spark, sf, "orders").select(value.alias("value")), schema)
    grouped = rows.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("malformed", bad.select("malformed").scalar())


HISTORY = """h AS (SELECT 'r' || lpad(o_orderkey::VARCHAR, 12, '0') AS run_id, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'rejected' ELSE 'skipped' END AS result,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000000 END AS f1 FROM orders)"""


def history(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("r"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("run_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.when(status == "F", "ok").when(status == "O", "rejected").otherwise("skipped").alias("result"),
        F.when(status == "F", F.col("o_totalprice") / 1_000_000).alias("if_baseline_f1"),
    )


@query(
    "last_retrain_runs",
    f"WITH {HISTORY} SELECT run_id, result FROM h ORDER BY ts DESC, run_id DESC LIMIT 10",
)
def last_retrain_runs(spark, sf):
    return ops.last_records(history(spark, sf), 10).select("run_id", "result")


@query(
    "rejected_retrain_share",
    f"""WITH {HISTORY}, r AS (SELECT result FROM h ORDER BY ts DESC, run_id DESC LIMIT 20)
SELECT count(*) AS recent, count(*) FILTER (WHERE result = 'rejected') AS rejected,
  count(*) >= 5 AND count(*) FILTER (WHERE result = 'rejected') / count(*) > 0.5 AS warn FROM r""",
)
def rejected_retrain_share(spark, sf):
    return alert_ops.rejected_share(history(spark, sf))


@query(
    "baseline_f1_series",
    f"WITH {HISTORY} SELECT epoch_us(ts) AS at, round(f1, 9) AS value FROM h WHERE f1 IS NOT NULL",
)
def baseline_f1_series(spark, sf):
    """Baseline F1 over time, runs without one left out."""
    s = ops.metric_series(history(spark, sf), F.col("if_baseline_f1"))
    return s.select(micros(F.col("at")).alias("at"), F.round("value", 9).alias("value"))


@query(
    "sandbox_delta_series",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE round(o_totalprice / 1000000 - 0.2, 9) END AS delta_f1 FROM orders""",
)
def sandbox_delta_series(spark, sf):
    """Nested delta of sandbox reports, 0 where a report has none."""
    delta = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1_000_000 - 0.2)
    o = table(spark, sf, "orders").withColumn("metrics", F.struct(delta.alias("delta_f1")))
    return o.select("o_orderkey", F.round(ops.delta_f1(F.col("metrics")), 9).alias("delta_f1"))


SANDBOX = """WITH p AS (SELECT quality AS t, toxic AS a, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS c FROM labels),
n AS (SELECT count(*) FILTER (WHERE t = 1 AND a = 1) AS atp, count(*) FILTER (WHERE t = 0 AND a = 1) AS afp,
  count(*) FILTER (WHERE t = 1 AND a = 0) AS afn, count(*) FILTER (WHERE t = 1 AND c = 1) AS ctp,
  count(*) FILTER (WHERE t = 0 AND c = 1) AS cfp, count(*) FILTER (WHERE t = 1 AND c = 0) AS cfn FROM p),
m AS (SELECT coalesce(2.0::DOUBLE * atp / nullif(2 * atp + afp + afn, 0), 0) AS af,
  coalesce(2.0::DOUBLE * ctp / nullif(2 * ctp + cfp + cfn, 0), 0) AS cf, coalesce(ctp::DOUBLE / nullif(ctp + cfp, 0), 0) AS cp FROM n)
SELECT round(af, 9) AS active_f1, round(cf, 9) AS candidate_f1, round(cp, 9) AS candidate_precision, round(cf - af, 9) AS delta_f1,
  CASE WHEN cf - af >= 0.01 AND cp >= 0.65 THEN 'ready_for_approval' ELSE 'rejected' END AS decision FROM m"""


@query("sandbox_decision", SANDBOX)
def sandbox_decision(spark, sf):
    """Candidate model against the active one on labelled rows."""
    q = F.col("quality")
    d = table(spark, sf, "labels").select(
        q.alias("t"),
        F.col("toxic").alias("a"),
        F.when(F.col("doc_id") % 4 == 0, 1 - q).otherwise(q).alias("c"),
    )
    r = metrics.sandbox_decision(d, "t", "a", "c", CFG)
    rounded = ("active_f1", "candidate_f1", "candidate_precision", "delta_f1")
    return r.select(*[F.round(c, 9).alias(c) for c in rounded], "decision")


@query(
    "retrain_guards",
    """SELECT o_orderstatus AS buffer, count(*) AS n, floor(count(*) * 0.8)::BIGINT AS split,
  CASE WHEN count(*) < 5000 THEN 'fewer than 5000 new rows' END AS skip_reason FROM orders GROUP BY 1""",
)
def retrain_guards(spark, sf):
    """Guard outcome of a buffer per order status."""
    o = table(spark, sf, "orders").withColumn("is_attack", F.lit(0))
    out = None
    for status in ("F", "O", "P"):
        g = metrics.retrain_guard(o.filter(F.col("o_orderstatus") == status), CFG)
        g = g.filter("n > 0").withColumn("buffer", F.lit(status))
        out = g if out is None else out.unionByName(g)
    return out


# Metric values of the gated models, read off the orders of each priority.
GATE = """m AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'isolation_forest' WHEN '2-HIGH' THEN 'random_forest'
    WHEN '3-MEDIUM' THEN 'bucket_isolation_forest' WHEN '4-NOT SPECIFIED' THEN 'reconstruction' ELSE 'sequence' END AS model,
  avg(o_totalprice) AS v, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS b FROM orders GROUP BY 1)"""


def gate_tables(spark, sf):
    p = F.col("o_orderpriority")
    model = (
        F.when(p == "1-URGENT", "isolation_forest")
        .when(p == "2-HIGH", "random_forest")
        .when(p == "3-MEDIUM", "bucket_isolation_forest")
        .when(p == "4-NOT SPECIFIED", "reconstruction")
        .otherwise("sequence")
    )
    metric = F.when(model == "reconstruction", "mse").otherwise("f1")
    o = table(spark, sf, "orders").withColumns({"model": model, "metric": metric})
    measured = o.groupBy("model", "metric").agg(F.avg("o_totalprice").alias("value"))
    base = o.filter("o_orderstatus = 'F'").groupBy("model", "metric").agg(
        F.avg("o_totalprice").alias("value")
    )
    return measured, base.filter("model <> 'sequence'")


@query(
    "validation_gate",
    f"""WITH {GATE}, d AS (SELECT model, v, CASE WHEN model <> 'sequence' THEN b END AS b FROM m)
SELECT model, round(v, 4) AS value, round(b, 4) AS baseline,
  CASE WHEN b IS NULL OR (model = 'reconstruction' AND v <= b * 1.12) OR (model = 'bucket_isolation_forest' AND v >= b - 0.05)
    OR (model IN ('isolation_forest', 'random_forest') AND v >= b) THEN 'accepted' ELSE 'rejected' END AS decision FROM d""",
)
def validation_gate(spark, sf):
    """Accept or reject each model's metric against its stored baseline."""
    g = metrics.validation_gate(*gate_tables(spark, sf), CFG)
    return g.select(
        "model", F.round("value", 4).alias("value"), F.round("baseline", 4).alias("baseline"), "decision"
    )


@query(
    "model_health",
    f"""WITH {GATE} SELECT model, round(v, 4) AS value, CASE model WHEN 'sequence' THEN 'warning' WHEN 'random_forest' THEN 'healthy'
  WHEN 'reconstruction' THEN CASE WHEN v <= b * 1.12 THEN 'healthy' ELSE 'degraded' END
  ELSE CASE WHEN v >= b - 0.02 THEN 'healthy' ELSE 'degraded' END END AS status,
  round(CASE WHEN model IN ('sequence', 'random_forest') THEN v ELSE b END, 4) AS next_reference FROM m""",
)
def model_health(spark, sf):
    """Health against references: one model has none yet, one is not configured."""
    measured, base = gate_tables(spark, sf)
    refs = base.select(
        "model",
        "metric",
        F.when(F.col("metric") == "mse", "lower").otherwise("higher").alias("direction"),
        F.when(F.col("metric") == "mse", 1.12).otherwise(0.02).alias("tolerance"),
        F.when(F.col("model") != "random_forest", F.col("value")).alias("reference"),
    )
    h = metrics.model_health(measured, refs)
    return h.select(
        "model", F.round("value", 4).alias("value"), "status", F.round("next_reference", 4).alias("next_reference")
    )


@query(
    "vocabulary_drift",
    f"""WITH {FLOWS}, t AS (SELECT * FROM flows WHERE "Timestamp" < TIMESTAMP '2024-01-16' AND event_type <> 'error'),
c AS (SELECT * FROM flows WHERE "Timestamp" >= TIMESTAMP '2024-01-16')
SELECT 'port' AS field, round(avg(("Source Port" NOT IN (SELECT "Source Port" FROM t))::INT), 9) AS oov_share,
  avg(("Source Port" NOT IN (SELECT "Source Port" FROM t))::INT) > 0.2 AS high_risk FROM c
UNION ALL SELECT 'protocol', round(avg(("Protocol" NOT IN (SELECT "Protocol" FROM t))::INT), 9),
  avg(("Protocol" NOT IN (SELECT "Protocol" FROM t))::INT) > 0.2 FROM c""",
)
def vocabulary_drift(spark, sf):
    """Share of later values the earlier half never saw."""
    f = flows(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    train = f.filter((F.col("Timestamp") < cut) & (F.col("event_type") != "error"))
    d = metrics.vocabulary_drift(
        train, f.filter(F.col("Timestamp") >= cut), {"port": "Source Port", "protocol": "Protocol"}
    )
    return d.withColumn("oov_share", F.round("oov_share", 9))


@query(
    "category_indexes",
    f"""WITH {FLOWS}, v AS (SELECT p, row_number() OVER (ORDER BY p) AS i FROM (SELECT DISTINCT "Destination Port"::VARCHAR AS p
  FROM flows WHERE "Destination Port" <> 8080))
SELECT row_id, coalesce(i, 0) AS port_index FROM flows LEFT JOIN v ON p = "Destination Port"::VARCHAR""",
)
def category_indexes(spark, sf):
    """Vocabulary index of the port; a port outside the vocabulary is 0."""
    from flowloom.operators.skew import row_positions

    f = flows(spark, sf)
    words = f.filter(F.col("Destination Port") != 8080).select(
        F.col("Destination Port").cast("string").alias("value")
    ).distinct()
    vocabulary = row_positions(words, [], ["value"], "index")
    return ops.category_index(f, vocabulary, "Destination Port", "port_index").select(
        "row_id", "port_index"
    )


@query(
    "row_fingerprints",
    "SELECT event_id, sha256(concat_ws('|', event_id, event_type, coalesce(CASE WHEN event_id % 3 > 0 THEN user_id END::VARCHAR, 'nan'))) AS fp FROM events",
)
def row_fingerprints(spark, sf):
    cols = [F.col("event_id"), F.col("event_type"), F.when(F.col("event_id") % 3 > 0, F.col("user_id"))]
    return table(spark, sf, "events").select("event_id", row_fingerprint(cols).alias("fp"))
