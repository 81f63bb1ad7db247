"""Upserts, incidents, status changes, labels and histories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.functions import scoring
from flowloom.functions.text import alert_hash, incident_id
from flowloom.operators.skew import lookup, lookup_by, trailing_frame
from flowloom.settings import INCIDENT_STATES

JOIN_FIELDS = ("ip", "ts", "threat_score")
WORKFLOW_FIELDS = ("created_at", "status", "owner", "tags")


def _stamped(df: DataFrame, batch: int, order: str) -> DataFrame:
    return df.withColumn("_at", F.struct(F.lit(batch).alias("b"), F.col(order).alias("o")))


def _with_key(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither missing nor empty."""
    return df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key."""
    rows = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(rows, order).alias("_r")).select("_r.*")


def upsert(
    existing: DataFrame, incoming: DataFrame, key: str, order: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Last write wins per key; returns the merged rows and (inserted, updated).

    ``order`` is each side's row order. Merged rows carry ``position``: old keys
    stay where they were, new keys follow in order of first appearance. A new
    key repeated inside the batch counts as one insert and then updates.
    """
    both = _stamped(_with_key(existing, key), 0, order).unionByName(
        _stamped(_with_key(incoming, key), 1, order), allowMissingColumns=True
    )
    rows = F.struct(*[F.col(f"`{c}`") for c in both.columns if c not in ("_at",)])
    merged = both.groupBy(F.col(key).alias("_key")).agg(
        F.max_by(rows, "_at").alias("_r"),
        F.min("_at").alias("position"),
        F.count_if(F.col("_at.b") == 1).alias("_written"),
    )
    fresh = F.col("position.b") == 1
    counts = merged.agg(
        F.count_if(fresh).alias("inserted"),
        F.coalesce(F.sum(F.col("_written") - F.when(fresh, 1).otherwise(0)), F.lit(0)).alias(
            "updated"
        ),
    )
    return merged.select("_r.*", "position"), counts


def incidents_from_alerts(alerts: DataFrame, now: dt.datetime) -> DataFrame:
    """One incident row per alert, identified by the alert's content."""
    present = alerts.columns

    def field(c: str, default) -> Column:
        return F.coalesce(F.col(c), F.lit(default)) if c in present else F.lit(default)

    score = field("threat_score", 0.0).cast("double")
    stamp = F.lit(now).cast("timestamp")
    hashed = alerts.withColumn("linked_alert_hash", alert_hash(present))
    return hashed.select(
        incident_id(F.col("linked_alert_hash")).alias("incident_id"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        F.lit("new").alias("status"),
        scoring.priority(score).alias("priority"),
        field("ip", "0.0.0.0").alias("ip"),
        (F.col("ts") if "ts" in present else F.lit(None).cast("timestamp")).alias("ts"),
        score.alias("threat_score"),
        field("recommendation", "").alias("recommendation"),
        F.struct(
            field("l1_triggered", False).alias("l1_triggered"),
            *[
                field(c, 0.0).cast("double").alias(c)
                for c in (
                    "l2_rf_attack_score",
                    "l2_ae_ratio",
                    "l2_lstm_attack_score",
                    "l2_emb_attack_score",
                )
            ],
        ).alias("signal"),
        F.struct(
            field("siem_failed_login", 0).cast("long").alias("failed_login"),
            field("siem_config_change", 0).cast("long").alias("config_change"),
        ).alias("siem"),
        F.lit(None).cast("string").alias("owner"),
        F.array(F.lit("detect_batch")).alias("tags"),
        "linked_alert_hash",
        "alert_seq",
    )


def sync_incidents(
    existing: DataFrame, alerts: DataFrame, now: dt.datetime, replace_workflow: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Alerts upserted into incidents.

    An incident already known keeps its creation time, status, owner and tags;
    ``replace_workflow`` resets them, as the published sync does.
    """
    incoming = incidents_from_alerts(alerts, now)
    merged, counts = upsert(existing, incoming, "incident_id", "alert_seq")
    if replace_workflow:
        return merged, counts
    kept = existing.select("incident_id", *[F.col(c).alias(f"_{c}") for c in WORKFLOW_FIELDS])
    joined = merged.join(kept, "incident_id", "left")
    known = F.col("position.b") == 0
    restored = {c: F.when(known, F.col(f"_{c}")).otherwise(F.col(c)) for c in WORKFLOW_FIELDS}
    return joined.withColumns(restored).drop(*[f"_{c}" for c in WORKFLOW_FIELDS]), counts


def change_status(
    incidents: DataFrame, changes: DataFrame, limit: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply (incident_id, seq, ts, status, owner, comment, actor) changes.

    Returns updated incidents, the audit rows (old value to new value) and the
    refused changes with their reason.
    """
    known = incidents.select("incident_id", F.col("status").alias("_current"))
    joined = lookup(changes, known, ["incident_id"], row_bytes=96)
    reason = F.when(~F.col("status").isin(*INCIDENT_STATES), "unknown status").when(
        F.col("_current").isNull(), "unknown incident"
    )
    judged = joined.withColumn("reason", reason)
    refused = judged.filter(F.col("reason").isNotNull()).drop("_current")
    accepted = judged.filter(F.col("reason").isNull()).drop("reason")
    chained = trailing_frame(
        accepted,
        ["incident_id"],
        ["seq"],
        1,
        {"_pair": lambda w: F.collect_list("status").over(w)},
        limit,
    )
    old = F.when(F.size("_pair") > 1, F.col("_pair")[0]).otherwise(F.col("_current"))
    audit = chained.select(
        F.concat(F.lit("act_"), F.col("seq").cast("string")).alias("action_id"),
        "incident_id",
        "ts",
        "actor",
        F.lit("set_status").alias("action"),
        old.alias("old_value"),
        F.col("status").alias("new_value"),
        "comment",
    )

    def last_given(c: str) -> Column:
        given = F.coalesce(F.col(c), F.lit("")) != ""
        return F.max_by(F.when(given, F.col(c)), F.when(given, F.col("seq")))

    final = accepted.groupBy("incident_id").agg(
        F.max_by("status", "seq").alias("_status"),
        F.max_by("ts", "seq").alias("_updated"),
        last_given("owner").alias("_owner"),
        last_given("comment").alias("_comment"),
    )
    base = incidents if "last_comment" in incidents.columns else incidents.withColumn(
        "last_comment", F.lit(None).cast("string")
    )
    updated = base.join(final, "incident_id", "left").withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "updated_at": F.coalesce("_updated", "updated_at"),
            "owner": F.coalesce("_owner", "owner"),
            "last_comment": F.coalesce("_comment", "last_comment"),
        }
    )
    return updated.drop("_status", "_updated", "_owner", "_comment"), audit, refused


def import_labels(
    existing: DataFrame,
    incoming: DataFrame,
    source: str,
    now: dt.datetime,
    stem: str = "import",
    order: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """Labelled samples upserted by ``sample_id``; blank ids are generated."""
    given = F.trim(F.col("sample_id").cast("string")) if "sample_id" in incoming.columns else F.lit("")
    made = F.concat(F.lit(f"smp_{stem}_"), F.col(order).cast("string"))
    stamped = incoming.withColumns(
        {
            "sample_id": F.when(F.coalesce(given, F.lit("")) == "", made).otherwise(given),
            "label_source": F.coalesce(F.col("label_source"), F.lit(source))
            if "label_source" in incoming.columns
            else F.lit(source),
            "imported_at": F.lit(now).cast("timestamp"),
        }
    )
    merged, counts = upsert(existing, stamped, "sample_id", order)
    columns = sorted(c for c in merged.columns if c != "position")
    return merged.select(*columns, "position"), counts


def union_columns(tables: list[DataFrame]) -> DataFrame:
    """Rows of different shapes under the sorted union of their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)])


def join_incidents(
    alerts: DataFrame, incidents: DataFrame, all_matches: bool = False
) -> DataFrame:
    """Alerts with incident id, and the incident's status and owner where set.

    The key is whichever of address, time and score both tables have; scores
    meet as whole cents, missing values meet each other. One incident, the
    last by update time and id, speaks for a key, so every alert stays one row
    and copies of an alert do not multiply. ``all_matches`` gives a row per
    distinct incident of the key instead, as the published join does.
    """
    shared = [c for c in JOIN_FIELDS if c in alerts.columns and c in incidents.columns]
    if not shared:
        return alerts

    def key(c: str) -> Column:
        return F.round(F.col(c) * 100).cast("long") if c == "threat_score" else F.col(c)

    extra = [c for c in ("incident_id", "status", "owner") if c in incidents.columns]
    keys = [f"_k{i}" for i in range(len(shared))]
    order = [F.col(c) for c in ("updated_at", "incident_id") if c in incidents.columns]
    side = incidents.select(
        *[key(c).alias(k) for k, c in zip(keys, shared)],
        *[F.col(c).alias(f"_{c}") for c in extra],
        F.struct(*order, F.lit(0)).alias("_order"),
    )
    if all_matches:
        side = side.drop("_order").distinct()
    else:
        row = F.struct(*[F.col(f"_{c}") for c in extra])
        side = side.groupBy(*keys).agg(F.max_by(row, "_order").alias("_r")).select(*keys, "_r.*")
    left = alerts.withColumns({k: key(c) for k, c in zip(keys, shared)})
    joined = lookup_by(left, side, keys) if all_matches else lookup(left, side, keys, 160)
    values = {}
    for c in extra:
        values[c] = (
            F.coalesce(F.col(f"_{c}"), F.col(c))
            if c in alerts.columns and c != "incident_id"
            else F.col(f"_{c}")
        )
    return joined.withColumns(values).drop(*[f"_{c}" for c in extra], *keys)


def action_history(actions: DataFrame, incident_ids: DataFrame) -> DataFrame:
    """Audit rows of the chosen incidents."""
    return actions.join(incident_ids.select("incident_id").distinct(), "incident_id", "left_semi")


def last_records(history: DataFrame, n: int = 10) -> DataFrame:
    return history.orderBy(F.col("ts").desc(), F.col("run_id").desc()).limit(max(n, 1))


def typed_history(history: DataFrame, time: str = "ts") -> DataFrame:
    """History with its ISO time parsed; an unreadable one is null."""
    return history.withColumn(f"{time}_parsed", F.try_to_timestamp(F.col(time)))


def metric_series(history: DataFrame, value: Column, time: str = "ts") -> DataFrame:
    """(time, value) in time order without the missing values."""
    typed = typed_history(history, time)
    return (
        typed.select(F.col(f"{time}_parsed").alias("at"), value.alias("value"))
        .dropna()
        .orderBy("at")
    )


def delta_f1(metrics: Column) -> Column:
    """``metrics.delta_f1`` of a sandbox report, 0 where it is absent."""
    return F.coalesce(metrics["delta_f1"].cast("double"), F.lit(0.0))


def category_index(df: DataFrame, vocabulary: DataFrame, column: str, out: str) -> DataFrame:
    """Vocabulary position of a value, 0 when unknown.

    ``vocabulary`` holds (value, index) with indexes from 1.
    """
    dim = vocabulary.select(F.col("value").alias("_v"), F.col("index").alias("_i"))
    keyed = df.withColumn("_v", F.col(f"`{column}`").cast("string"))
    joined = lookup(keyed, dim, ["_v"], row_bytes=64)
    return joined.withColumn(out, F.coalesce(F.col("_i"), F.lit(0))).drop("_v", "_i")
