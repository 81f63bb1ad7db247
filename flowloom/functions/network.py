"""Addresses, protocols and flow keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowloom.functions.cleaning import parse_double

# --- fixed values: protocol numbers and non-routable IPv4 blocks ---
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP"}
NON_ROUTABLE_V4 = (
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 29),
    ("192.0.0.170", 31),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
)
# --- end of fixed values ---

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"


def protocol_token(proto: Column) -> Column:
    """6, 17 and 1 by name, other numbers as ``P<n>``, text upper-cased."""
    text = proto.cast("string")
    number = F.nanvl(parse_double(text), F.lit(None).cast("double"))
    code = number.cast("int")
    token = F.when(code.isNull(), F.upper(F.trim(text)))
    for value, label in PROTOCOL_NAMES.items():
        token = token.when(code == value, F.lit(label))
    return token.otherwise(F.concat(F.lit("P"), code.cast("string")))


def flow_key(
    src: Column, sport: Column, dst: Column, dport: Column, proto: Column
) -> Column:
    """``src|sport|dst|dport|proto``; missing parts print as empty."""
    parts = (src, sport, dst, dport)
    return F.concat_ws(
        "|",
        *[F.coalesce(p.cast("string"), F.lit("")) for p in parts],
        F.coalesce(protocol_token(proto), F.lit("")),
    )


def reverse_flow_key(key: Column) -> Column:
    p = F.split(key, r"\|")
    return F.concat_ws("|", p[2], p[3], p[0], p[1], p[4])


def ipv4_number(ip: Column) -> Column:
    """IPv4 text as a 32-bit number, null when it is not an IPv4 address."""
    clean = F.trim(ip)
    parts = F.split(clean, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("long")
    return F.when(clean.rlike(IPV4), value)


def block_bounds(network: str, prefix: int) -> tuple[int, int]:
    low = 0
    for octet in network.split("."):
        low = low * 256 + int(octet)
    return low, low + (1 << (32 - prefix)) - 1


def is_routable(ip: Column) -> Column:
    """True for a public IPv4 address; anything else, bad text too, is false."""
    number = ipv4_number(ip)
    private = F.lit(False)
    for network, prefix in NON_ROUTABLE_V4:
        low, high = block_bounds(network, prefix)
        private = private | number.between(low, high)
    return F.coalesce(number.isNotNull() & ~private, F.lit(False))


def plot_position(ip: Column) -> tuple[Column, Column]:
    """Map coordinates of an address: (A·256+B, C·256+D).

    Two leading numbers alone give (A, B); anything else is the origin.
    """
    parts = F.split(F.coalesce(ip, F.lit("")), r"\.")
    digits = [
        F.when(
            F.try_element_at(parts, F.lit(i + 1)).rlike("^[0-9]+$"),
            F.try_element_at(parts, F.lit(i + 1)).try_cast("double"),
        )
        for i in range(4)
    ]
    a, b, c, d = digits
    full = (
        (F.size(parts) >= 4)
        & a.isNotNull()
        & b.isNotNull()
        & c.isNotNull()
        & d.isNotNull()
    )
    pair = (F.size(parts) >= 2) & a.isNotNull() & b.isNotNull()
    x = F.when(full, a * 256 + b).when(pair, a).otherwise(F.lit(0.0))
    y = F.when(full, c * 256 + d).when(pair, b).otherwise(F.lit(0.0))
    return x, y
