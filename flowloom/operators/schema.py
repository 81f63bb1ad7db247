"""Schema completion and checks of flow tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from flowloom.functions.cleaning import is_attack, name, number_or_zero
from flowloom.settings import (
    BASE_NUMERIC,
    CATEGORICAL_COLUMNS,
    CONTEXT_COLUMNS,
    CRITICAL_COLUMNS,
    HEADER_BYTES,
    HEADER_PACKETS,
    Settings,
)

HEADER_WIDTH = HEADER_PACKETS * HEADER_BYTES
CORPORATE_REQUIRED = ("Label", "Source IP", "Destination IP")
CORPORATE_RECOMMENDED = ("Protocol", "Destination Port")


class SchemaError(ValueError):
    """An input table that must not be processed further."""


def column_report(df: DataFrame, findings: list[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(findings, "level string, message string")


def check_critical(df: DataFrame, allow_missing: bool = False) -> list[tuple[str, str]]:
    level = "warning" if allow_missing else "error"
    return [(level, f"missing column {c}") for c in CRITICAL_COLUMNS if c not in df.columns]


def check_corporate(df: DataFrame, strict_timestamp: bool = False) -> list[tuple[str, str]]:
    """(level, message) findings for a corporate labelled table."""
    found = [
        ("error", f"missing column {c}") for c in CORPORATE_REQUIRED if c not in df.columns
    ]
    if df.isEmpty():
        found.append(("error", "table has no rows"))
    if "Timestamp" not in df.columns:
        found.append(
            ("error" if strict_timestamp else "warning", "missing column Timestamp")
        )
    found += [
        ("warning", f"missing column {c}")
        for c in CORPORATE_RECOMMENDED
        if c not in df.columns
    ]
    return found


def raise_errors(findings: list[tuple[str, str]]) -> None:
    errors = [m for level, m in findings if level == "error"]
    if errors:
        raise SchemaError("; ".join(errors))


def complete_schema(
    df: DataFrame,
    numeric: tuple[str, ...] = BASE_NUMERIC,
    context: tuple[str, ...] = CONTEXT_COLUMNS,
    base_time: dt.datetime | None = None,
) -> DataFrame:
    """Add absent columns with their defaults, in one projection.

    Without a Timestamp column, rows get one millisecond steps from
    ``base_time`` (now when not given) in ``row_id`` order. Enriched columns
    are not filled here; the enrichment makes them.
    """
    enriched = ("http_", "dns_", "hdr_", "hb_")
    add = {}
    if "Label" not in df.columns:
        add["Label"] = F.lit("BENIGN")
    if "Timestamp" not in df.columns:
        base = F.lit(base_time or dt.datetime.now()).cast("timestamp")
        add["Timestamp"] = F.timestamp_micros(F.unix_micros(base) + F.col("row_id") * 1000)
    for c in numeric:
        if not c.startswith(enriched) and c not in df.columns:
            add[c] = F.lit(0.0)
    if "Protocol" not in df.columns:
        add["Protocol"] = F.lit("TCP")
    for c in ("Destination Port", "Source Port"):
        if c not in df.columns:
            add[c] = F.lit(0)
    for c in context:
        if c not in df.columns and c not in add:
            add[c] = F.lit("0.0.0.0")
    return df.withColumns(add) if add else df


def prepared_columns(df: DataFrame, cfg: Settings) -> list[str]:
    """Names of the prepared table in their order."""
    wanted = ["row_id", "Timestamp", *cfg.numeric_features, *CATEGORICAL_COLUMNS, *CONTEXT_COLUMNS]
    wanted += ["Destination IP", "flow_key", "header_bytes", "Label"]
    return [c for c in dict.fromkeys(wanted) if c in df.columns]


def select_prepared(df: DataFrame, cfg: Settings) -> DataFrame:
    """Typed output: numeric block as doubles, then ``is_attack``."""
    texts = {n for n, t in df.dtypes if t == "string"}
    numeric = set(cfg.numeric_features)
    columns = [
        number_or_zero(name(c), c in texts).alias(c) if c in numeric else name(c)
        for c in prepared_columns(df, cfg)
    ]
    return df.select(*columns, is_attack(name("Label")).alias("is_attack"))


def prepared_invariants(df: DataFrame) -> DataFrame:
    """One row: label mismatches, header block width and whether it is all zero."""
    mismatch = is_attack(name("Label")) != F.coalesce(F.col("is_attack").cast("int"), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(mismatch).alias("label_mismatches")]
    if "header_bytes" in df.columns:
        widths = F.octet_length("header_bytes")
        filled = F.replace(F.hex("header_bytes"), F.lit("0"), F.lit("")) != ""
        aggs += [
            F.count_if(F.coalesce(widths, F.lit(HEADER_WIDTH)) != HEADER_WIDTH).alias(
                "bad_header_widths"
            ),
            F.coalesce(~F.max(filled), F.lit(True)).alias("header_all_zero"),
        ]
    return df.agg(*aggs)


def split_by_class(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Benign rows and attack rows (label trimmed, any case)."""
    benign = F.upper(F.trim(name("Label"))) == "BENIGN"
    return df.filter(benign), df.filter(~benign)
