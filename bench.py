"""Headline queries, one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from flowloom import catalog
from flowloom.catalog.base import flows
from flowloom.catalog.models import CFG, FEATURES, labelled
from flowloom.operators import isolation, models
from flowloom.plans.prepare import prepare
from flowloom.session import local_session

HEADLINES = (
    "detect_alerts",
    "detect_alerts_ungated",
    "chunked_detection",
    "suppressed_alerts",
    "time_bucket_sums",
    "level1_flow_flags",
    "rolling_uri_deviation",
    "packet_flows",
    "packet_sequences",
    "header_byte_blocks",
    "proxy_flows",
    "upserted_rows",
    "incidents_synced",
)


def prepare_all(spark, sf):
    """Every prepared column, not only those the check looks at."""
    return prepare(flows(spark, sf, uri=True))


def train_forest_and_isolation(spark, sf):
    """Forest of 200 trees and 24 levels and isolation forest, both of the published size."""
    f = labelled(spark, sf).select("row_id", "is_attack", *FEATURES)
    forest = models.fit_forest(f, FEATURES, CFG)
    return isolation.fit(f, FEATURES, trees=CFG.isolation_trees).flag(forest.score(f))


def run(fn, spark, sf) -> float:
    start = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "flowloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.load()[0]
    work = {"prepare": prepare_all, "train_forest_and_isolation": train_forest_and_isolation}
    work.update({n: known[n] for n in HEADLINES})
    run(known["detect_alerts"], spark, sf)  # starts the JVM and the Python workers
    seconds = {}
    for name, fn in work.items():
        seconds[name] = run(fn, spark, sf)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr)
    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "flow_rows": rows,
                "flow_rows_per_sec": {
                    n: round(rows / seconds[n])
                    for n in ("prepare", "detect_alerts", "detect_alerts_ungated", "chunked_detection",
                              "train_forest_and_isolation")
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
