"""SIEM counts and locations put beside alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowloom.functions.network import ipv4_number, is_routable
from flowloom.operators.skew import lookup
from flowloom.session import materialize
from flowloom.settings import SIEM_TYPES

PREFIX_SHIFT = 16


def siem_counts(events: DataFrame) -> DataFrame:
    """Events of each known type per address, in one pass."""
    kind = F.col("event_type")
    return events.groupBy("ip").agg(*[F.count_if(kind == t).alias(t) for t in SIEM_TYPES])


def join_siem(alerts: DataFrame, counts: DataFrame) -> DataFrame:
    """Alerts with their address's counts, 0 where it has none."""
    joined = lookup(alerts, counts.filter(F.col("ip").isNotNull()), ["ip"], row_bytes=80)
    return joined.withColumns({t: F.coalesce(F.col(t), F.lit(0)) for t in SIEM_TYPES})


def locate(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, latitude, longitude) of distinct routable addresses.

    ``ranges`` holds disjoint (low, high, latitude, longitude). Both sides meet
    on the upper 16 bits, in order of their numbers; each address looks at the last
    range that began before it. A prefix holds at most 65,536 distinct addresses and
    as many ranges, so this is one bounded merge.
    """
    shifted = lambda c: F.shiftright(F.col(c), PREFIX_SHIFT)
    points = (
        addresses.filter(is_routable(F.col("ip")))
        .select("ip")
        .distinct()
        .withColumn("_n", ipv4_number(F.col("ip")))
        .withColumn("_prefix", shifted("_n"))
    )
    spread = ranges.withColumn("_prefix", F.explode(F.sequence(shifted("low"), shifted("high"))))
    begin = F.greatest(F.col("low"), F.shiftleft(F.col("_prefix"), PREFIX_SHIFT))
    starts = spread.select(
        F.lit(None).cast("string").alias("ip"), begin.cast("long").alias("_n"), "_prefix",
        F.struct("high", "latitude", "longitude").alias("_range"),
    )
    marks = points.select("ip", F.col("_n").cast("long").alias("_n"), "_prefix").withColumn(
        "_range", F.lit(None).cast(starts.schema["_range"].dataType)
    )
    upto = Window.partitionBy("_prefix").orderBy("_n", F.col("ip").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    met = starts.unionByName(marks).withColumn("_met", F.last("_range", ignorenulls=True).over(upto))
    return (
        met.filter(F.col("ip").isNotNull() & (F.col("_n") <= F.col("_met.high")))
        .filter(F.col("_met.latitude").isNotNull() & F.col("_met.longitude").isNotNull())
        .select("ip", "_met.latitude", "_met.longitude")
    )


def join_locations(
    flows: DataFrame, ranges: DataFrame, source: str = "ip", destination: str = "dst_ip"
) -> DataFrame:
    """Location of the destination where it has one, else of the source."""
    both = flows.select(F.explode(F.array(source, destination)).alias("ip"))
    located = materialize(locate(both, ranges))
    out = flows
    for column, tag in ((destination, "d"), (source, "s")):
        dim = located.select(
            F.col("ip").alias(column),
            F.col("latitude").alias(f"_{tag}lat"),
            F.col("longitude").alias(f"_{tag}lon"),
        )
        out = lookup(out, dim, [column], row_bytes=64)
    return out.withColumns(
        {
            "latitude": F.coalesce("_dlat", "_slat"),
            "longitude": F.coalesce("_dlon", "_slon"),
        }
    ).drop("_dlat", "_dlon", "_slat", "_slon")
