"""Proxy log lines to flow rows, with a count of every outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowloom.functions.cleaning import parse_double
from flowloom.functions.text import json_kind, let

# --- fixed values: record layout and clamps of the published ingest ---
REQUIRED = ("ts", "client_ip", "host")
PROXY_FIELDS = (
    "ts",
    "client_ip",
    "method",
    "host",
    "port",
    "path",
    "scheme",
    "status",
    "bytes_up",
    "bytes_down",
    "duration_ms",
    "error",
)
OUTCOMES = (
    "valid_records",
    "empty_lines",
    "invalid_json",
    "invalid_type",
    "missing_required_fields",
)
PACKET_BYTES = 512
MAX_BYTES_RATE = 1e9
MAX_PACKET_RATE = 1e6
MIN_SECONDS = 1e-6
# --- end of fixed values ---

PROXY_JSON = T.StructType([T.StructField(n, T.StringType()) for n in PROXY_FIELDS])


def with_outcome(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``outcome`` to each line; required keys may hold null."""

    def of(text: Column) -> Column:
        keys = F.json_object_keys(text)
        lacking = F.lit(False)
        for field in REQUIRED:
            lacking = lacking | ~F.array_contains(keys, field)

        def by_kind(kind: Column) -> Column:
            return (
                F.when(kind == "", F.lit("invalid_json"))
                .when(kind != "object", F.lit("invalid_type"))
                .when(lacking, F.lit("missing_required_fields"))
                .otherwise(F.lit("valid_records"))
            )

        judged = let(F.coalesce(json_kind(text), F.lit("")), by_kind)
        return F.when(text == "", F.lit("empty_lines")).otherwise(judged)

    return lines.withColumn("outcome", let(F.trim(F.col(column)), of))


def outcome_counts(marked: DataFrame) -> DataFrame:
    """One row: processed lines and the count of every outcome."""
    return marked.agg(
        F.count(F.lit(1)).alias("processed_lines"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
    )


def quarantine(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("outcome") != "valid_records")


def _text(c: str, default: str) -> Column:
    """The field, or the default when it is absent or blank."""
    v = F.col(f"r.{c}")
    return F.when(v.isNull() | (v == ""), F.lit(default)).otherwise(v)


def _whole(c: str, default: int = 0) -> Column:
    """Whole number; absent and 0 read as the default."""
    v = F.coalesce(F.col(f"r.{c}").try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    return F.when(v == 0, F.lit(default).cast("long")).otherwise(v)


def to_flows(marked: DataFrame, column: str = "value") -> DataFrame:
    """Flow rows of the valid lines, in one projection.

    Other columns of the input (a line number, a file) are kept.
    """
    keep = [c for c in marked.columns if c not in (column, "outcome")]

    def parsed(text: Column) -> Column:
        failed = F.array_contains(F.json_object_keys(text), "error")
        return F.struct(F.from_json(text, PROXY_JSON).alias("r"), failed.alias("failed"))

    valid = marked.filter(F.col("outcome") == "valid_records")
    r = valid.select(*keep, let(F.trim(F.col(column)), parsed).alias("p")).select(*keep, "p.r", "p.failed")
    seconds = F.greatest(
        F.coalesce(parse_double(F.col("r.duration_ms")), F.lit(0.0)) / 1000.0,
        F.lit(MIN_SECONDS),
    )
    base = r.select(
        *keep,
        "r",
        "failed",
        seconds.alias("seconds"),
        _whole("bytes_up").alias("up"),
        _whole("bytes_down").alias("down"),
        _text("host", "unknown").alias("host"),
        _whole("port", 443).alias("port"),
        _text("path", "").alias("raw_path"),
        _text("scheme", "https").alias("scheme"),
        F.upper(_text("method", "CONNECT")).alias("method"),
        _whole("status").alias("status"),
    )
    packets_up = F.greatest(F.floor(F.col("up") / PACKET_BYTES), F.lit(1)).cast("long")
    packets_down = F.greatest(F.floor(F.col("down") / PACKET_BYTES), F.lit(0)).cast("long")
    path = F.when(
        (F.col("raw_path") != "") & ~F.col("raw_path").startswith("/"),
        F.concat(F.lit("/"), F.col("raw_path")),
    ).otherwise(F.col("raw_path"))
    shaped = base.withColumns({"fwd": packets_up, "bwd": packets_down, "path": path})
    mean_up = F.col("up").cast("double") / F.col("fwd")
    epoch = parse_double(F.col("r.ts"))
    stamp = F.when(
        epoch.isNotNull(), F.date_trunc("second", F.timestamp_seconds(epoch))
    ).otherwise(F.try_to_timestamp(F.col("r.ts")))
    return shaped.select(
        *keep,
        stamp.alias("Timestamp"),
        F.col("r.client_ip").alias("Source IP"),
        F.round("seconds", 6).alias("Flow Duration"),
        F.col("fwd").alias("Total Fwd Packets"),
        F.col("bwd").alias("Total Backward Packets"),
        F.least(F.lit(1500), F.greatest(F.col("up"), F.lit(64))).alias("Fwd Packet Length Max"),
        F.least(
            F.lit(100), F.greatest(F.floor(F.col("up") / F.col("fwd")), F.lit(0))
        ).alias("Fwd Packet Length Min"),
        mean_up.alias("Fwd Packet Length Mean"),
        F.least(F.lit(1500), F.greatest(F.col("down"), F.lit(0))).alias("Bwd Packet Length Max"),
        F.round(
            F.least(
                (F.col("up") + F.col("down")).cast("double") / F.col("seconds"),
                F.lit(MAX_BYTES_RATE),
            ),
            6,
        ).alias("Flow Bytes/s"),
        F.round(
            F.least(
                (F.col("fwd") + F.col("bwd")).cast("double") / F.col("seconds"),
                F.lit(MAX_PACKET_RATE),
            ),
            6,
        ).alias("Flow Packets/s"),
        (F.col("method") == "CONNECT").cast("int").alias("SYN Flag Count"),
        F.col("status").isin(200, 204).cast("int").alias("FIN Flag Count"),
        F.col("failed").cast("int").alias("RST Flag Count"),
        F.lit(6).alias("Protocol"),
        F.col("port").cast("int").alias("Destination Port"),
        F.concat(
            F.col("scheme"),
            F.lit("://"),
            F.col("host"),
            F.lit(":"),
            F.col("port").cast("string"),
            F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")),
        ).alias("http_request_uri"),
        F.when(F.col("host").contains("."), F.col("host"))
        .otherwise(F.concat(F.col("host"), F.lit(".local")))
        .alias("dns_qname"),
        F.lit("BENIGN").alias("Label"),
    )
