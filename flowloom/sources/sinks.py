"""Alert and incident outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators.skew import Order, sort_columns


def first_alerts(alerts: DataFrame, limit: int = 200) -> DataFrame:
    return alerts.orderBy("alert_seq").limit(limit)


def last_alerts(alerts: DataFrame, limit: int = 200) -> DataFrame:
    return alerts.orderBy(F.col("alert_seq").desc()).limit(limit)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below ``path``."""
    jvm, root = spark.sparkContext._jvm, path.rstrip("/")
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(place) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def keep_last(rows: DataFrame, path: str, version: int, limit: int, order: Order) -> None:
    """The first ``limit`` rows, in ``order``, of the version before and of ``rows``, as a version of its own.

    Readers see a version once it is whole (``read_last``). The same version written again
    starts from the same one before it; versions older than that are removed.
    """
    spark = rows.sparkSession
    there = _versions(spark, path)
    before = [v for v in there if v < version]
    if before:
        rows = rows.unionByName(spark.read.parquet(f"{path}/version={before[-1]}"), allowMissingColumns=True)
    rows.orderBy(*sort_columns(order)).limit(limit).write.mode("overwrite").parquet(f"{path}/version={version}")
    jvm = spark.sparkContext._jvm
    for old in before[:-1]:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read_last(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of what ``keep_last`` keeps."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def write_alerts(alerts: DataFrame, path: str, limit: int = 200) -> None:
    """The first alerts of a batch run as JSON lines."""
    first_alerts(alerts, limit).coalesce(1).write.mode("overwrite").json(path)


def incident_cards(incidents: DataFrame) -> DataFrame:
    """Incidents as flat rows for JSON or CSV export."""
    flat = {
        "siem_failed_login": ("siem.failed_login", 0),
        "siem_config_change": ("siem.config_change", 0),
        "l1_triggered": ("signal.l1_triggered", False),
        "l2_rf_attack_score": ("signal.l2_rf_attack_score", 0.0),
        "l2_ae_ratio": ("signal.l2_ae_ratio", 0.0),
        "l2_lstm_attack_score": ("signal.l2_lstm_attack_score", 0.0),
        "l2_emb_attack_score": ("signal.l2_emb_attack_score", 0.0),
    }
    plain = (
        "incident_id",
        "created_at",
        "updated_at",
        "status",
        "priority",
        "owner",
        "ip",
        "ts",
        "threat_score",
        "recommendation",
    )
    return incidents.select(
        *plain,
        *[F.coalesce(F.col(c), F.lit(default)).alias(n) for n, (c, default) in flat.items()],
    )


def write_cards(incidents: DataFrame, path: str, form: str = "json") -> None:
    writer = incident_cards(incidents).write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
