"""Session helpers: a tuned local session and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "flowloom") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only on a single machine that names none is a folder of our own made.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="flowloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh, never reused path below the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/flowloom/{tag}-{uuid.uuid4().hex}"


FEW_SPLITS = 8
SPREAD_BYTES = 4 << 20  # of a file, for each task of a spread input


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input of a few splits over the cores.

    One file of one row group is one task, whatever follows it. That matters
    only for inputs of at most eight splits (about 1 GiB); anything larger
    already has tasks enough and is left as it is, without a shuffle. Tasks
    grow in number with the input, so that what one of them reads stays bounded.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits > FEW_SPLITS:
        return df
    tasks = max(cores, _file_bytes(df) // SPREAD_BYTES)
    return df.repartition(tasks) if splits < tasks else df


def _file_bytes(df: DataFrame) -> int:
    """Size of the files that a table is read from, as the planner knows it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


def materialize(df: DataFrame, coalesced: bool = True) -> DataFrame:
    """Cut lineage on reliable shared storage (never executor-local).

    Unless ``coalesced``, small shuffle partitions stay apart, as in a cached table:
    a fit adds up its rows partition by partition, so their layout is part of its result.
    """
    spark = df.sparkSession
    scratch_root(spark)
    before = spark.conf.get(COALESCE)
    try:
        if not coalesced:
            spark.conf.set(COALESCE, "false")
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(COALESCE, before)
