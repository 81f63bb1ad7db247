"""Packet tables to flows, per-flow statistics and per-flow tensors.

A packet table has one row per packet: ``pkt_no, ts, ip_src, sport, ip_dst,
dport, proto, length, ip_len, ip_declared_len, ttl, tcp_flags, tcp_window,
udp_len, ip_bytes, payload, dns_qname``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.functions import text
from flowloom.functions.network import flow_key, protocol_token, reverse_flow_key
from flowloom.functions.scoring import packet_vector
from flowloom.operators.skew import lookup
from flowloom.session import materialize
from flowloom.settings import (
    HEADER_BYTES,
    HEADER_PACKETS,
    PACKET_FEATURES,
    PACKETS_PER_FLOW,
    PLAINTEXT_FEATURES,
)

SYN, FIN, RST = 0x02, 0x01, 0x04
TUPLE = ("ip_src", "sport", "ip_dst", "dport", "proto")
HEADER_WIDTH = HEADER_PACKETS * HEADER_BYTES
ZERO_BYTE = "00"


def with_ports(packets: DataFrame) -> DataFrame:
    """Ports count only for TCP and UDP; elsewhere they are 0."""
    carries = F.col("proto").isin(6, 17)
    return packets.withColumns(
        {p: F.when(carries, F.col(p)).otherwise(F.lit(0)) for p in ("sport", "dport")}
    )


def with_packet_key(packets: DataFrame) -> DataFrame:
    return with_ports(packets).withColumn(
        "flow_key", flow_key(*[F.col(c) for c in TUPLE])
    )


def packet_flows(packets: DataFrame) -> DataFrame:
    """One flow per directed 5-tuple; first and last time in arrival order."""
    tcp = F.col("proto") == 6

    def flag(bit: int) -> Column:
        return F.count_if(tcp & (F.col("tcp_flags").bitwiseAND(bit) != 0))

    grouped = with_ports(packets).groupBy(*TUPLE).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("length").alias("bytes"),
        F.min_by("ts", "pkt_no").alias("first"),
        F.max_by("ts", "pkt_no").alias("last"),
        F.max("length").alias("longest"),
        F.min("length").alias("shortest"),
        F.avg("ttl").alias("ip_ttl_mean"),
        F.max(F.when(tcp, F.col("tcp_window"))).alias("window"),
        flag(SYN).alias("syn"),
        flag(FIN).alias("fin"),
        flag(RST).alias("rst"),
    )
    seconds = F.greatest(F.col("last") - F.col("first"), F.lit(1e-9))
    n, total = F.col("n").cast("double"), F.col("bytes").cast("double")
    return grouped.select(
        F.col("ip_src").alias("Source IP"),
        F.col("ip_dst").alias("Destination IP"),
        F.col("sport").alias("Source Port"),
        F.col("dport").alias("Destination Port"),
        protocol_token(F.col("proto")).alias("Protocol"),
        (seconds * 1_000_000).cast("long").alias("Flow Duration"),
        F.col("n").alias("Total Fwd Packets"),
        F.lit(0).alias("Total Backward Packets"),
        F.col("longest").alias("Fwd Packet Length Max"),
        F.col("shortest").alias("Fwd Packet Length Min"),
        (total / n).alias("Fwd Packet Length Mean"),
        F.lit(0).alias("Bwd Packet Length Max"),
        (total / seconds).alias("Flow Bytes/s"),
        (n / seconds).alias("Flow Packets/s"),
        F.col("syn").alias("SYN Flag Count"),
        F.col("fin").alias("FIN Flag Count"),
        F.col("rst").alias("RST Flag Count"),
        "ip_ttl_mean",
        F.coalesce(F.col("window").cast("double"), F.lit(0.0)).alias("tcp_window_max"),
    )


def sort_flows(flows: DataFrame) -> DataFrame:
    """Flows in 5-tuple order, for writing."""
    return flows.orderBy(
        "Source IP", "Destination IP", "Source Port", "Destination Port", "Protocol"
    )


def plaintext_stats(packets: DataFrame) -> DataFrame:
    """Per flow: longest DNS name, its largest entropy, longest HTTP line."""
    port = lambda n: (F.col("sport") == n) | (F.col("dport") == n)
    dns = (F.col("proto") == 17) & port(53)
    name = F.regexp_replace(F.col("dns_qname"), r"\.+$", "")
    shaped = with_packet_key(packets).select(
        "flow_key",
        F.when(dns & (name != ""), name).alias("name"),
        F.when((F.col("proto") == 6) & port(80), text.http_line(F.col("payload"))).alias("line"),
    )
    found = shaped.filter(F.col("name").isNotNull() | F.col("line").isNotNull()).select(
        "flow_key",
        F.length("name").cast("double").alias("name_len"),
        F.when(
            F.col("name").isNotNull(), text.byte_entropy(F.encode("name", "UTF-8"))
        ).alias("name_entropy"),
        F.length("line").cast("double").alias("line_len"),
    )
    return found.groupBy("flow_key").agg(
        F.coalesce(F.max("name_len"), F.lit(0.0)).alias("pcap_dns_qname_len_max"),
        F.coalesce(F.max("name_entropy"), F.lit(0.0)).alias("pcap_dns_qname_entropy_max"),
        F.coalesce(F.max("line_len"), F.lit(0.0)).alias("pcap_http_first_line_len_max"),
        F.lit(1.0).alias("pcap_plaintext_hits"),
    )


def first_packets(packets: DataFrame, k: int) -> DataFrame:
    """The first ``k`` packets of each flow, numbered from 1.

    The rank limit is applied before the shuffle as well (group limit), so a
    huge flow sends at most ``k`` rows per input task.
    """
    order = Window.partitionBy("flow_key").orderBy("pkt_no")
    return packets.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= k)


def _in_slot_order(value: Column) -> Column:
    # sort_array compares in compiled code, array_sort calls a lambda for each comparison
    return F.sort_array(F.collect_list(F.struct(F.col("slot"), value.alias("v"))))["v"]


def _padded(sequence: Column, k: int) -> Column:
    """``sequence`` with vectors of zeros behind it, up to ``k`` vectors."""
    empty = F.array_repeat(F.lit(0.0).cast("float"), PACKET_FEATURES)
    return F.concat(sequence, F.array_repeat(empty, F.lit(k) - F.size(sequence)))


def packet_sequences(packets: DataFrame, k: int = PACKETS_PER_FLOW, padded: bool = True) -> DataFrame:
    """(flow_key, sequence): k vectors of twelve numbers, zero-padded (or not yet)."""
    vector = packet_vector(
        F.col("ip_len"),
        F.col("ttl"),
        F.col("proto"),
        F.col("tcp_flags"),
        F.col("ip_declared_len") - F.col("ip_len"),
        F.col("udp_len"),
    )
    # vectors are made after the rank limit: the shuffle carries raw columns only
    first = first_packets(with_packet_key(packets), k).select(
        "flow_key", "slot", vector.alias("vector")
    )
    grouped = first.groupBy("flow_key").agg(_in_slot_order(F.col("vector")).alias("sequence"))
    return grouped.withColumn("sequence", _padded(F.col("sequence"), k)) if padded else grouped


def match_direction(packets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Packets of the wanted keys in either direction, under the wanted key.

    Both directions share one canonical key, so a single join decides: the
    forward key wins, then the reverse one, and other packets are dropped.
    """
    forward = F.col("flow_key")
    backward = reverse_flow_key(forward)
    canonical = F.least(forward, backward)
    keys = (
        wanted.select("flow_key")
        .distinct()
        .groupBy(canonical.alias("_pair"))
        .agg(
            F.max(forward == canonical).alias("_has_low"),
            F.max(forward != canonical).alias("_has_high"),
        )
    )
    keyed = packets.withColumns({"_pair": canonical, "_back": backward})
    joined = lookup(keyed, keys, ["_pair"], row_bytes=128)
    low = F.col("flow_key") == F.col("_pair")
    has_forward = F.when(low, F.col("_has_low")).otherwise(F.col("_has_high"))
    has_backward = F.when(low, F.col("_has_high")).otherwise(F.col("_has_low"))
    chosen = F.when(has_forward, F.col("flow_key")).when(has_backward, F.col("_back"))
    return (
        joined.withColumn("flow_key", chosen)
        .filter(F.col("flow_key").isNotNull())
        .drop("_pair", "_back", "_has_low", "_has_high")
    )


def header_blocks(packets: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(flow_key, header_bytes): 24 packets of 40 bytes, zero-padded, 960 bytes."""
    keyed = with_packet_key(packets).withColumn(
        "header", F.substring("ip_bytes", 1, HEADER_BYTES)
    ).select("flow_key", "pkt_no", "header")
    if wanted is not None:
        keyed = match_direction(keyed, wanted)
    zero = F.unhex(F.lit(ZERO_BYTE))
    padded = F.rpad(F.col("header"), F.lit(HEADER_BYTES), zero)
    grouped = (
        first_packets(keyed, HEADER_PACKETS)
        .groupBy("flow_key")
        .agg(_in_slot_order(padded).alias("rows"))
    )
    joined = F.unhex(F.array_join(F.transform("rows", lambda b: F.hex(b)), ""))
    return grouped.select(
        "flow_key", F.rpad(joined, F.lit(HEADER_WIDTH), zero).alias("header_bytes")
    )


SCALED = (np.arange(256) / 255.0).astype(np.float32)  # a byte's value between 0 and 1


def header_matrix(data: pa.Array) -> np.ndarray:
    """Header blocks as rows of ``HEADER_WIDTH`` bytes; a missing block is zeros."""
    zeros = bytes(HEADER_WIDTH)
    blocks = [zeros if b is None else b for b in data.to_pylist()]
    if any(len(b) != HEADER_WIDTH for b in blocks):
        raise ValueError(f"a header block has {HEADER_WIDTH} bytes")
    return np.frombuffer(b"".join(blocks), np.uint8).reshape(len(blocks), HEADER_WIDTH)


def scaled_header(data: Column) -> Column:
    """Header bytes scaled to 0..1; all zero where a flow has none."""

    def scaled(blocks):
        flat = SCALED[header_matrix(blocks).ravel()]
        ends = np.arange(len(blocks) + 1, dtype=np.int32) * HEADER_WIDTH
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    scaled.__annotations__ = {"blocks": pa.Array, "return": pa.Array}
    return F.arrow_udf(scaled, "array<float>")(data)


def stride_means(data: Column, stride: int) -> Column:
    """Means of the scaled header block over strides of so many bytes, as doubles."""
    exact = SCALED.astype(float)
    width = HEADER_WIDTH // stride

    def means(blocks):
        parts = header_matrix(blocks).reshape(len(blocks), width, stride)
        total = np.zeros((len(blocks), width))
        for i in range(stride):  # added up in order, for every row alike
            total += exact[parts[:, :, i]]
        ends = np.arange(len(blocks) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(ends), pa.array((total / stride).ravel()))

    means.__annotations__ = {"blocks": pa.Array, "return": pa.Array}
    return F.arrow_udf(means, "array<double>")(data)


def join_plaintext(flows: DataFrame, stats: DataFrame) -> DataFrame:
    joined = lookup(flows, materialize(stats), ["flow_key"], row_bytes=160)
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in PLAINTEXT_FEATURES}
    )


def join_header_bytes(flows: DataFrame, blocks: DataFrame) -> DataFrame:
    return lookup(flows, materialize(blocks), ["flow_key"], row_bytes=HEADER_WIDTH + 128)


def join_sequences(
    flows: DataFrame, sequences: DataFrame, k: int = PACKETS_PER_FLOW, padded: bool = True
) -> DataFrame:
    """Flows with ``sequence`` (zeros where none) and the ``found`` mask.

    Sequences that are not to be padded are left as short as they come, and empty where none.
    """
    joined = lookup(flows, materialize(sequences), ["flow_key"], row_bytes=k * PACKET_FEATURES * 4 + 256)
    sequence = F.coalesce(F.col("sequence"), F.array().cast("array<array<float>>"))
    return joined.withColumns(
        {
            "found": F.col("sequence").isNotNull(),
            "sequence": _padded(sequence, k) if padded else sequence,
        }
    )


MOMENTS = "place int, n long, filled long, total decimal(38,0), squares decimal(38,0)"


def _byte_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a byte of the block and task: rows, values that are not 0, sum and sum of squares."""
    n, sums = 0, np.zeros((3, HEADER_WIDTH), np.int64)
    for b in batches:
        block = header_matrix(b.column(0))
        n += len(block)
        sums[0] += np.count_nonzero(block, axis=0)
        sums[1] += block.sum(axis=0, dtype=np.int64)
        sums[2] += np.square(block, dtype=np.uint16).sum(axis=0, dtype=np.int64)
    if n:
        whole = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(HEADER_WIDTH, dtype=np.int32)),
                pa.array(np.full(HEADER_WIDTH, n, np.int64)),
                pa.array(sums[0]),
                pa.array(sums[1].tolist(), whole),
                pa.array(sums[2].tolist(), whole),
            ],
            names=["place", "n", "filled", "total", "squares"],
        )


def header_quality(df: DataFrame, column: str = "header_bytes") -> DataFrame:
    """One row grading the header block by its density and mean variance."""
    n, total = F.sum("n"), F.sum("total")
    per_byte = (
        df.select(F.col(column).alias("block"))
        .mapInArrow(_byte_moments, MOMENTS)
        .groupBy("place")
        .agg(
            F.sum("filled").alias("filled"),
            n.alias("n"),
            # of whole numbers, so exact up to the division
            F.when(n > 1, (F.sum("squares") - total * total / n) / (n - 1)).otherwise(F.lit(0.0)).alias("variance"),
        )
    )
    measured = per_byte.agg(
        (F.coalesce(F.sum("filled"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).cast("double"))
        .alias("nonzero_fraction"),
        (F.coalesce(F.sum("variance"), F.lit(0.0)).cast("double") / (255.0 * 255.0 * HEADER_WIDTH)).alias("variance_mean"),
    )
    grade = (
        F.when(
            (F.col("nonzero_fraction") <= 0.0001) | (F.col("variance_mean") <= 1e-10),
            "constant_or_empty",
        )
        .when(F.col("nonzero_fraction") < 0.01, "weak")
        .otherwise("good")
    )
    return measured.select(
        F.lit(HEADER_WIDTH).alias("columns_present"),
        F.round("nonzero_fraction", 8).alias("nonzero_fraction"),
        "variance_mean",
        grade.alias("signal_quality"),
    )
