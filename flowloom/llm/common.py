"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowloom.session import scratch_path


BATCH_ROWS = 1000  # whole texts that travel to a Python worker together
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts are long, and both sides hold a batch in memory."""
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(df: DataFrame, name: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def partitions(df: DataFrame, at_least: int = 1) -> int:
    """Shuffle partitions of the session, for operators that deal out rows themselves."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: cuts lineage, compressed."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_whole_rows(df: DataFrame, fn, fields: list[T.StructField]) -> DataFrame:
    """mapInArrow over all columns whatever their names; batches have columns by place."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    places = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return plain.mapInArrow(fn, places).toDF(*[f.name for f in fields])


def by_place(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterable[pa.RecordBatch]:
    """Parts of a batch, so that few rows are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _values(column: pa.Array, rows: int = 256) -> Iterable:
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def chunks(texts: pa.Array | list[str], most: int = 1 << 20) -> Iterable[tuple[int, list[str]]]:
    """Runs of whole texts of about ``most`` characters, each with the place of its first text."""
    start, held, size = 0, [], 0
    for i, t in enumerate(_values(texts) if isinstance(texts, pa.Array) else texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


class Bits:
    """A set of hashes as 2 ** ``bits`` places, so of fixed size whatever it holds; members are never missed."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits, self.shift = bits, np.uint64(64 - bits)
        self.words = np.zeros(1 << (bits - 6), np.uint64) if words is None else words

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = hashes >> self.shift
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        word, bit = self.places(hashes)
        return (self.words[word] & bit) != 0

    def joined(self, df: DataFrame, hashes) -> Bits:
        """With the hashes of all rows of ``df`` (a function of a batch); one row a word of 64 bits comes back."""

        def rows(batches):
            for b in batches:
                word, bit = self.places(hashes(b))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["at", "bit"])

        found = df.mapInArrow(rows, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
        words = self.words.copy()
        words[found.column("at").to_numpy()] |= found.column("bit").to_numpy().view(np.uint64)
        return Bits(self.bits, words)
