"""Guarded online retraining: fit on new rows, validate, accept or reject.

Everything lives below one root folder: ``state`` (progress), ``baselines``
(accepted metric values), ``history`` (one row per run) and one versioned
folder per accepted model. A rejected model is simply not published, so the
last accepted path stays the active one.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.functions.scoring import zero_if_null
from flowloom.operators import isolation, metrics, models, traffic
from flowloom.operators.sampling import positional_split
from flowloom.session import materialize
from flowloom.settings import Settings
from flowloom.sources.flows import path_exists
from flowloom.streaming import progress

BASELINE = "model string, metric string, value double, run_id string, path string, at timestamp"
HISTORY = (
    "run_id string, ts timestamp, result string, reason string, input_rows long, "
    "if_f1 double, if_baseline_f1 double, decisions string"
)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def current_baselines(spark: SparkSession, root: str) -> DataFrame:
    """Latest accepted value per model and metric."""
    rows = read_or_empty(spark, f"{root}/baselines", BASELINE)
    return rows.groupBy("model", "metric").agg(
        F.max_by("value", F.struct("at", "run_id")).alias("value"),
        F.max_by("path", F.struct("at", "run_id")).alias("path"),
    )


def _f1(df: DataFrame, guess) -> float:
    scored = df.select(F.col("is_attack"), guess.cast("int").alias("g"))
    return metrics.binary_metrics(scored, "is_attack", "g").first()["f1"]


def retrain_once(
    buffer: DataFrame,
    root: str,
    features: list[str],
    cfg: Settings | None = None,
    generation: int = 0,
    deep: bool = True,
    now: dt.datetime | None = None,
) -> DataFrame:
    """One run over the buffer's new rows; returns its history row."""
    cfg = cfg or Settings()
    spark = buffer.sparkSession
    now = now or dt.datetime.now()
    run_id = f"rt_{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"
    state = read_or_empty(spark, f"{root}/state", progress.STATE + ", at timestamp")
    latest = state.orderBy(F.col("at").desc()).limit(1).drop("at")
    place = progress.start_position(buffer, latest, generation).first()

    def finish(result: str, reason: str, rows: int, f1=None, base=None, decisions: str = "") -> DataFrame:
        row = spark.createDataFrame(
            [(run_id, now, result, reason, rows, f1, base, decisions)], HISTORY
        )
        row.write.mode("append").parquet(f"{root}/history")
        if result in ("ok", "rejected"):
            done = progress.prefix_digest(buffer, place["last"], generation)
            done.withColumn("at", F.lit(now).cast("timestamp")).write.mode("append").parquet(
                f"{root}/state"
            )
        return row

    if place["last"] is None or place["last"] < place["start"]:
        return finish("skipped", "nothing new to train on", 0)
    fresh = progress.new_rows(buffer, place["start"])
    guard = metrics.retrain_guard(fresh, cfg).first()
    if guard["skip_reason"]:
        return finish("skipped", guard["skip_reason"], guard["n"])
    train, held = positional_split(fresh, cfg.validation_ratio)
    train, held = materialize(train), materialize(held)
    base = {r["model"]: r["value"] for r in current_baselines(spark, root).collect()}
    try:
        forest = isolation.fit(
            train, features, trees=cfg.isolation_trees, contamination=cfg.contamination, seed=cfg.seed
        )
        f1 = _f1(forest.flag(held), F.col("is_anomaly"))
    except Exception as e:  # a failed fit must not stop the caller's loop
        return finish("error", f"isolation forest failed: {e}", guard["n"])
    gate = metrics.validation_gate(
        spark.createDataFrame([("isolation_forest", "f1", f1)], "model string, metric string, value double"),
        current_baselines(spark, root),
        cfg,
    ).first()
    before = base.get("isolation_forest")
    if gate["decision"] == "rejected":
        return finish("rejected", "held-out F1 below the accepted one", guard["n"], f1, before)
    candidates = _other_candidates(train, held, features, cfg, deep)
    saved = {"isolation_forest": (forest, "f1", f1), **candidates}
    measured = spark.createDataFrame(
        [(m, metric, float(v)) for m, (_, metric, v) in saved.items()],
        "model string, metric string, value double",
    )
    verdicts = metrics.validation_gate(measured, current_baselines(spark, root), cfg).collect()
    accepted = []
    for v in verdicts:
        if v["decision"] != "accepted":
            continue
        model = saved[v["model"]][0]
        path = f"{root}/models/{v['model']}/{run_id}"
        if isinstance(model, isolation.IsolationForest):
            model.save(spark, path)
        else:
            model.save(path)
        accepted.append((v["model"], v["metric"], v["value"], run_id, path, now))
    spark.createDataFrame(accepted, BASELINE).write.mode("append").parquet(f"{root}/baselines")
    notes = ", ".join(sorted(f"{v['model']}={v['decision']}" for v in verdicts))
    return finish("ok", "", guard["n"], f1, before, notes)


def _other_candidates(
    train: DataFrame, held: DataFrame, features: list[str], cfg: Settings, deep: bool
) -> dict:
    """Refitted models with their validation metric; one that cannot fit is left out."""
    out: dict[str, tuple] = {}

    def attempt(model: str, make) -> None:
        try:
            fitted = make()
        except Exception as e:
            print(f"{model} skipped: {e}")
            return
        if fitted is not None:
            out[model] = fitted

    def forest():
        ch = models.fit_forest(train, features, cfg)
        return ch, "f1", _f1(ch.score(held), F.col(ch.out) >= 0.5)

    def buckets():
        seconds = cfg.bucket_seconds
        dense = traffic.training_buckets(train, seconds)
        check = traffic.training_buckets(held, seconds, least=2)
        if dense is None or check is None:
            return None
        columns = [c for c in dense.columns if c != "bucket"]
        model = isolation.fit(
            dense, columns, key="bucket", trees=cfg.isolation_trees, contamination=cfg.contamination
        )
        labels = traffic.bucket_attack_labels(held, seconds)
        joined = model.flag(check).join(labels, "bucket", "left")
        truth = joined.withColumn("is_attack", F.coalesce("attack", F.lit(0)))
        return model, "f1", _f1(truth, F.col("is_anomaly"))

    def reconstruction():
        ch = models.fit_reconstruction(train, features, cfg)
        benign = ch.score(models.with_class(held).filter("_class = 'BENIGN'"))
        mse = benign.agg(F.avg("l2_ae_mse")).first()[0]
        return None if mse is None else (ch, "mse", mse)

    def sequence():
        ch = models.fit_sequence(train, features, cfg)
        return ch, "f1", _f1(ch.score(held), zero_if_null(F.col(ch.out)) >= 0.5)

    def categorical():
        ch = models.fit_categorical(train, features, cfg)
        scored = ch.score(held)
        right = ((F.col(ch.out) >= 0.5).cast("int") == F.col("is_attack")).cast("double")
        return ch, "accuracy", scored.agg(F.avg(right)).first()[0]

    attempt("random_forest", forest)
    attempt("bucket_isolation_forest", buckets)
    if deep:
        attempt("reconstruction", reconstruction)
        attempt("sequence", sequence)
        attempt("categorical", categorical)
    return out
