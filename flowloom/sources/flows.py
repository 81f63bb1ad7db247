"""Flow tables from CSV, with a columnar cache, and the prepared-table sinks."""

from __future__ import annotations

import csv
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from flowloom.functions.cleaning import clean_header, name, parse_timestamp
from flowloom.operators.sampling import limit_rows
from flowloom.operators.schema import SchemaError, check_corporate, raise_errors
from flowloom.operators.skew import lookup
from flowloom.session import materialize, scratch_root

REPLACEMENT_MARKS = ("\ufffd", "\u0000")


class InputError(ValueError):
    """An input file that cannot be read as what it should be."""


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Cleaned header of the first file (one line is read)."""
    first = spark.read.text(path).first()
    if first is None:
        raise InputError(f"empty file: {path}")
    return clean_header(next(csv.reader([first["value"]])))


def distinct_ignoring_case(names: list[str]) -> list[str]:
    """Spark resolves names without case, so a second spelling gets a suffix."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n.lower(), 0)
        seen[n.lower()] = k + 1
        out.append(n if k == 0 else f"{n}_{k + 1}")
    return out


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text under its cleaned name, plus where the row lies."""
    names = distinct_ignoring_case(header_names(spark, path))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def with_row_ids(df: DataFrame) -> DataFrame:
    """Dense 0-based ``row_id`` in file order (file, block, line); rows stay where they are.

    A first pass counts the rows of each split and notes the number Spark gives to its first
    row. Sums over one row a split (40 bytes, so millions of splits can be sent to all tasks)
    say where each split begins; a second pass adds the place inside the split. Files must
    not change in between: a split that was not counted is an error.
    """
    key = ["_part", "_file", "_block"]
    path = F.col("_metadata.file_path")
    place = [
        F.spark_partition_id().alias("_part"), F.xxhash64(path).alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"),
    ]
    counts = df.select(path.alias("_path"), *place).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), F.min("_path").alias("_path")
    )
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select(*key, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    placed = lookup(df.select("*", *place), starts, key, row_bytes=40)
    known = F.when(F.col("_shift").isNull(), F.raise_error(F.lit("files changed while rows were numbered"))).otherwise(F.col("_shift"))
    return placed.withColumn("row_id", F.col("_id") + known).drop(*key, "_id", "_shift")


def check_text(df: DataFrame, path: str) -> None:
    """Fail on an empty table and on bytes that were not UTF-8."""
    if df.isEmpty():
        raise InputError(f"no rows: {path}")
    broken = F.lit(False)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            for mark in REPLACEMENT_MARKS:
                broken = broken | F.coalesce(name(field.name).contains(mark), F.lit(False))
    if not df.filter(broken).isEmpty():
        raise InputError(f"not UTF-8 text: {path}; convert the file and run again")


def read_flow_csv(
    spark: SparkSession, path: str, strict: bool = False, row_ids: bool = True
) -> DataFrame:
    """Public flow CSV: clean header, ``Label`` alias, parsed Timestamp."""
    df = read_csv_text(spark, path)
    if strict:
        check_text(df, path)
    if row_ids:
        df = with_row_ids(df)
    if "Timestamp" in df.columns:
        df = df.withColumn("Timestamp", parse_timestamp(F.col("Timestamp")))
    return df


def read_corporate_csv(
    spark: SparkSession, path: str, strict_timestamp: bool = False
) -> DataFrame:
    """Corporate labelled CSV, refused when required columns are missing."""
    df = read_flow_csv(spark, path, strict=True)
    raise_errors(check_corporate(df, strict_timestamp))
    return df


def read_labelled_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several labelled CSVs in one scan, under the union of their columns, with ``source_file``.

    Each file may have its columns in an order of its own, and columns of its own (null in the
    others). ``row_id`` is dense over all files, in the order of their paths. Headers, one row a
    file, come to the driver, since the columns depend on them; no value may hold a line break.
    """
    text = spark.read.text(paths).select("value", "_metadata").filter(F.trim("value") != "")
    numbered = with_row_ids(text).select(
        "value", "row_id", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file")
    )
    heads = numbered.groupBy("_path").agg(F.min("row_id").alias("first"), F.min_by("value", "row_id").alias("head"))
    found = sorted((r["first"], r["_path"], r["head"]) for r in heads.collect())
    if not found:
        raise InputError(f"no rows: {', '.join(paths)}")
    names = [distinct_ignoring_case(clean_header(next(csv.reader([head])))) for _, _, head in found]
    spelled: dict[str, str] = {}
    for n in (n for of_file in names for n in of_file):
        spelled.setdefault(n.lower(), n)
    maps = []
    for k, (of_file, (first, path, _)) in enumerate(zip(names, found)):
        place = {n.lower(): i for i, n in enumerate(of_file)}
        maps.append((path, first, k + 1, [place.get(n) for n in spelled]))
    placed = spark.createDataFrame(maps, "_path string, _first long, _heads long, _place array<int>")
    width = max(len(of_file) for of_file in names)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    rows = lookup(numbered, placed, ["_path"], row_bytes=100 + 4 * len(spelled)).filter(F.col("row_id") != F.col("_first"))
    fields = rows.withColumn("_s", F.from_csv("value", schema.simpleString()[7:-1].replace(":", " ")))
    fields = fields.withColumn("_v", F.array(*[F.col(f"_s.c{i}") for i in range(width)]))
    df = fields.select(
        *[F.get("_v", F.get("_place", F.lit(i))).alias(n) for i, n in enumerate(spelled.values())],
        (F.col("row_id") - F.col("_heads")).alias("row_id"), "source_file",
    )
    return df.withColumn("Timestamp", parse_timestamp(F.col("Timestamp"))) if "Timestamp" in df.columns else df


def source_stamp(spark: SparkSession, path: str) -> str:
    """Digest of a path's files with their sizes and modification times."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(
        f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in fs.listStatus(root)
    )
    return hashlib.sha1("\n".join(found).encode()).hexdigest()


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_flows(
    spark: SparkSession,
    path: str,
    row_limit: int = 0,
    columnar_cache: bool = False,
    cache_root: str | None = None,
) -> DataFrame:
    """Flow table with an optional row limit (0 or less: all rows).

    The cache is a Parquet copy named by the source's files, sizes and times,
    so a changed source is read afresh.
    """
    if path.rstrip("/").endswith(".parquet"):
        return limit_rows(spark.read.parquet(path), row_limit)
    if not columnar_cache:
        return limit_rows(read_flow_csv(spark, path), row_limit)
    root = (cache_root or scratch_root(spark)).rstrip("/")
    copy = f"{root}/flow-cache/{source_stamp(spark, path)}"
    if not path_exists(spark, f"{copy}/_SUCCESS"):
        read_flow_csv(spark, path).write.mode("overwrite").parquet(copy)
    return limit_rows(spark.read.parquet(copy), row_limit)


def write_prepared(df: DataFrame, path: str, append: bool = False) -> None:
    """Overwrite, or append when names and order equal the table's."""
    spark = df.sparkSession
    if append and path_exists(spark, path):
        there = spark.read.parquet(path).columns
        if there != df.columns:
            missing = [c for c in there if c not in df.columns]
            extra = [c for c in df.columns if c not in there]
            raise SchemaError(
                f"append refused: missing {missing}, extra {extra}, or a different order"
            )
    df.write.mode("append" if append else "overwrite").parquet(path)
