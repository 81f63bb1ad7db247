"""Classification metrics and the gates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.settings import Settings


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(truth: str, guess: str) -> dict[str, Column]:
    t, g = F.col(truth) == 1, F.col(guess) == 1
    return {
        "tn": F.count_if(~t & ~g),
        "fp": F.count_if(~t & g),
        "fn": F.count_if(t & ~g),
        "tp": F.count_if(t & g),
    }


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(df: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, F1, false positive rate, precision, recall and the four counts."""
    counts = df.groupBy(*(by or [])).agg(
        *[c.alias(n) for n, c in confusion(truth, guess).items()]
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        *(by or []),
        "tn",
        "fp",
        "fn",
        "tp",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(fp, fp + tn).alias("fpr"),
        *[c.alias(n) for n, c in rates(tp, fp, fn).items()],
    )


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class precision, recall, F1 and support, then macro and weighted means.

    Works on the table of (truth, guess) counts, one row per pair of classes.
    """
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.lit("truth").alias("side")),
                F.struct(F.col("g").alias("label"), F.lit("guess").alias("side")),
            )
        ).alias("x"),
        "n",
        (F.col("t") == F.col("g")).alias("hit"),
    ).select("x.label", "x.side", "n", "hit")
    per_class = sides.groupBy("label").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "truth", F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("side") == "guess", F.col("n"))), F.lit(0)).alias("guessed"),
        F.coalesce(
            F.sum(F.when(F.col("hit") & (F.col("side") == "truth"), F.col("n"))), F.lit(0)
        ).alias("hits"),
    )
    scored = per_class.select(
        "label",
        ratio(F.col("hits"), F.col("guessed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1"),
        "support",
    )
    measures = ("precision", "recall", "f1")
    macro = scored.agg(
        F.lit("macro avg").alias("label"),
        *[F.avg(m).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    weighted = scored.agg(
        F.lit("weighted avg").alias("label"),
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    return scored.unionByName(macro).unionByName(weighted)


def retrain_guard(
    rows: DataFrame, cfg: Settings, flag: str = "is_attack"
) -> DataFrame:
    """One row: row count, split position and why a retrain is skipped (or null)."""
    n = F.col("n")
    split = F.floor(n * (1 - cfg.validation_ratio)).cast("long")
    reason = (
        F.when(F.lit(flag not in rows.columns), "no attack flag to validate on")
        .when(n < cfg.min_retrain_rows, f"fewer than {cfg.min_retrain_rows} new rows")
        .when((split <= 0) | (split >= n), "nothing left to train or validate on")
    )
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        "n", split.alias("split"), reason.alias("skip_reason")
    )


def gate_rules(cfg: Settings) -> list[tuple[str, str, str, float, bool]]:
    """(model, metric, direction, tolerance, equality accepted) per gated model."""
    return [
        ("isolation_forest", "f1", "higher", 0.0, cfg.accept_equal_f1),
        ("random_forest", "f1", "higher", 0.0, cfg.accept_equal_f1),
        ("bucket_isolation_forest", "f1", "higher", cfg.bucket_f1_slack, True),
        ("reconstruction", "mse", "lower", cfg.max_mse_ratio, True),
        ("sequence", "f1", "higher", cfg.sequence_f1_slack, True),
        ("categorical", "accuracy", "higher", cfg.categorical_accuracy_slack, True),
    ]


def validation_gate(measured: DataFrame, baseline: DataFrame, cfg: Settings) -> DataFrame:
    """(model, metric, value) against its baseline: accept or reject, with the new one.

    No baseline accepts. An accepted value replaces the baseline.
    """
    rules = measured.sparkSession.createDataFrame(
        gate_rules(cfg),
        "model string, metric string, direction string, tolerance double, equal_ok boolean",
    )
    base = baseline.select("model", "metric", F.col("value").alias("baseline"))
    v, b, tol = F.col("value"), F.col("baseline"), F.col("tolerance")
    passes = (
        F.when(b.isNull(), True)
        .when(F.col("direction") == "lower", v <= b * tol)
        .when(F.col("equal_ok"), v >= b - tol)
        .otherwise(v > b - tol)
    )
    return (
        measured.join(F.broadcast(rules), ["model", "metric"])  # six fixed rows
        .join(base, ["model", "metric"], "left")
        .select(
            "model",
            "metric",
            "value",
            "baseline",
            F.when(passes, "accepted").otherwise("rejected").alias("decision"),
            F.when(passes, v).otherwise(b).alias("next_baseline"),
        )
    )


def model_health(measured: DataFrame, references: DataFrame) -> DataFrame:
    """Health of each model's metric against its stored reference.

    ``references``: model, metric, direction, tolerance, reference. A first
    value becomes the reference.
    """
    v, ref, tol = F.col("value"), F.col("reference"), F.col("tolerance")
    fine = F.when(F.col("direction") == "lower", v <= ref * tol).otherwise(v >= ref - tol)
    status = (
        F.when(F.col("direction").isNull() | v.isNull(), "warning")
        .when(ref.isNull(), "healthy")
        .when(fine, "healthy")
        .otherwise("degraded")
    )
    note = (
        F.when(F.col("direction").isNull(), "no rule for this metric")
        .when(v.isNull(), "not measured")
        .when(ref.isNull(), "first value, kept as reference")
        .otherwise("within or beyond its rule")
    )
    return measured.join(references, ["model", "metric"], "left").select(
        "model",
        "metric",
        "value",
        status.alias("status"),
        note.alias("note"),
        F.coalesce(ref, v).alias("next_reference"),
    )


def sandbox_decision(
    df: DataFrame, truth: str, active: str, candidate: str, cfg: Settings
) -> DataFrame:
    """Candidate against active on labelled rows, both measured in one pass."""
    both = df.agg(
        *[c.alias(f"a_{n}") for n, c in confusion(truth, active).items()],
        *[c.alias(f"c_{n}") for n, c in confusion(truth, candidate).items()],
    )

    def of(prefix: str) -> dict[str, Column]:
        return rates(*[F.col(f"{prefix}_{n}") for n in ("tp", "fp", "fn")])

    measured = both.select(
        *[c.alias(f"active_{n}") for n, c in of("a").items()],
        *[c.alias(f"candidate_{n}") for n, c in of("c").items()],
    ).withColumn("delta_f1", F.col("candidate_f1") - F.col("active_f1"))
    ready = (F.col("delta_f1") >= cfg.sandbox_min_delta_f1) & (
        F.col("candidate_precision") >= cfg.sandbox_min_precision
    )
    return measured.withColumn(
        "decision", F.when(ready, "ready_for_approval").otherwise("rejected")
    )


def vocabulary_drift(
    train: DataFrame, current: DataFrame, columns: dict[str, str], high: float = 0.2
) -> DataFrame:
    """Share of values the training vocabulary lacks, per column, with a risk flag.

    Values are counted first, so the join sees one row per distinct value.
    """
    aggs = []
    for label, column in columns.items():
        known = train.select(F.col(f"`{column}`").cast("string").alias("v")).distinct()
        seen = current.groupBy(F.col(f"`{column}`").cast("string").alias("v")).agg(
            F.count(F.lit(1)).alias("n")
        )
        marked = seen.join(known.withColumn("known", F.lit(True)), "v", "left")
        share = ratio(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)), F.sum("n"))
        aggs.append(marked.agg(F.lit(label).alias("field"), share.alias("oov_share")))
    out = aggs[0]
    for a in aggs[1:]:
        out = out.unionByName(a)
    return out.withColumn("high_risk", F.col("oov_share") > high)
