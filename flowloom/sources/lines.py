"""Line-delimited JSON and JSON arrays: SIEM events, proxy logs, row tables.

A line that is not JSON, or not an object, never fails a job: it is left out
or counted. ``read.json`` is not used on lines, since it turns a line holding
an array into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowloom.functions.text import json_kind
from flowloom.sources.flows import path_exists

# --- fixed values: accepted spellings of SIEM fields, in order of preference ---
IP_ALIASES = ("client_ip", "source_ip", "src_ip", "host_ip")
TYPE_ALIASES = ("event", "evt", "type", "eventName")
# --- end of fixed values ---

SIEM_FIELDS = ("ip", *IP_ALIASES, "event_type", *TYPE_ALIASES, "timestamp", "ts", "severity")
SIEM_JSON = T.StructType([T.StructField(n, T.StringType()) for n in SIEM_FIELDS])
SIEM_COLUMNS = "ip string, event_type string, timestamp string, severity string"


def object_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Only the lines holding a JSON object."""
    return lines.filter(json_kind(F.col(column)) == "object")


def parse_objects(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    kept = object_lines(lines, column)
    return kept.select(F.from_json(F.trim(F.col(column)), schema).alias("r")).select("r.*")


def first_present(df: DataFrame, target: str, aliases: tuple[str, ...]) -> Column:
    """The target where set, else the first alias the table has at all.

    A column exists for the whole table when any row carries it; that one
    question is answered by a single aggregate.
    """
    present = [c for c in (target, *aliases) if c in df.columns]
    if not present:
        return F.lit(None).cast("string")
    used = df.agg(*[F.count(c).alias(c) for c in present]).first().asDict()
    alias = next((a for a in aliases if used.get(a)), None)
    parts = [F.col(c) for c in (target if used.get(target) else None, alias) if c]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def normalize_siem(df: DataFrame, mode: str = "first_present") -> DataFrame:
    """(ip, event_type, timestamp, severity) from the accepted spellings.

    ``first_present`` takes the first alias column of the table, ``any`` the
    first alias set in each row.
    """
    if mode == "any":
        pick = lambda t, al: F.coalesce(
            *[F.col(c) for c in (t, *al) if c in df.columns]
        )
    else:
        pick = lambda t, al: first_present(df, t, al)
    stamp = [F.col(c) for c in ("timestamp", "ts") if c in df.columns]
    return df.select(
        pick("ip", IP_ALIASES).alias("ip"),
        pick("event_type", TYPE_ALIASES).alias("event_type"),
        (F.coalesce(*stamp) if stamp else F.lit(None).cast("string")).alias("timestamp"),
        (F.col("severity") if "severity" in df.columns else F.lit(None).cast("string")).alias(
            "severity"
        ),
    )


def read_siem_lines(spark: SparkSession, path: str, mode: str = "first_present") -> DataFrame:
    """SIEM events from NDJSON; a missing source is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], SIEM_COLUMNS)
    return normalize_siem(parse_objects(spark.read.text(path), SIEM_JSON), mode)


def read_siem_array(spark: SparkSession, path: str, mode: str = "first_present") -> DataFrame:
    """SIEM events from a file holding one JSON array."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], SIEM_COLUMNS)
    return normalize_siem(spark.read.schema(SIEM_JSON).option("multiLine", True).json(path), mode)


def load_rows(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Row table kept as JSON lines: the rows, and one row with the bad-line count."""
    kind = json_kind(F.col("value"))
    bad = lines.agg(
        F.count_if((F.trim("value") != "") & kind.isNull()).alias("malformed")
    )
    return parse_objects(lines, schema), bad


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples from CSV or from a JSON array, by suffix."""
    if path.lower().rstrip("/").endswith(".json"):
        return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    return spark.read.option("header", True).csv(path)
