"""Alert suppression as a stream: one kept time per (ip, severity).

A call into a stateful processor and its state costs milliseconds, whatever it brings. So keys
share a fixed number of buckets: the processor is called once for a bucket, with the alerts of
all its keys, and reads and writes the bucket's kept times at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowloom.functions.cleaning import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "alert_seq long, ip string, severity string"
STATE = "ip array<string>, severity array<string>, us array<bigint>"
BUCKETS = 1024  # fixed for a checkpoint folder
NO_SEQ = (1 << 63) - 1  # stands for a missing alert_seq, which comes last


class LastKept(StatefulProcessor):
    """Keeps the time of the last alert let through of each key of a bucket, across micro-batches."""

    def __init__(self, window_micros: int):
        self.window = window_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values("alert_seq", kind="stable")
        last = {}
        if self.last.exists():
            ips, severities, times = self.last.get()
            last = dict(zip(zip(ips, severities), times))
        names = [batch[c].astype(object).where(batch[c].notna(), None) for c in ("ip", "severity")]
        kept = []
        for i, (who, us) in enumerate(zip(zip(*names), batch["us"].tolist())):
            before = last.get(who)
            if before is None or us - before > self.window:
                last[who] = us
                kept.append(i)
        if kept:
            self.last.update(([ip for ip, _ in last], [severity for _, severity in last], list(last.values())))
            yield batch.iloc[kept][["alert_seq", "ip", "severity"]]

    def close(self) -> None:
        pass


def suppress_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    out: str,
    checkpoint: str,
    window_seconds: int,
    max_files: int | None = None,
) -> StreamingQuery:
    """Alerts (alert_seq, ip, severity, ts) that survive, in arrival order per key.

    ``max_files`` bounds a micro-batch, and with it what one bucket can bring.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    alerts = reader.parquet(source).select(
        F.pmod(F.xxhash64("ip", "severity"), F.lit(BUCKETS)).alias("bucket"),
        F.coalesce(F.col("alert_seq").cast("long"), F.lit(NO_SEQ)).alias("alert_seq"),
        "ip",
        "severity",
        F.coalesce(micros(F.col("ts")), F.unix_micros(F.current_timestamp())).alias("us"),
    )
    return (
        alerts.groupBy("bucket")
        .transformWithStateInPandas(
            LastKept(window_seconds * 1_000_000), OUTPUT, "Append", "None"
        )
        .withColumn("alert_seq", F.nullif("alert_seq", F.lit(NO_SEQ)))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
