"""String features: URIs, DNS names, entropies, fingerprints, JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# --- fixed values: markers of the published rules ---
SUSPICIOUS_URI_PARTS = ("/admin", "/wp-login", "/.env", "/login", "/phpmyadmin")
HTTP_LINE_STARTS = ("GET ", "POST ", "PUT ", "HEAD ", "HTTP/")
HTTP_LINE_BYTES = 512
METHOD_BUCKETS = 997
FINGERPRINT_BUCKETS = 512
URI_NAME_PARTS = ("url", "uri", "http.request", "request_uri")
METHOD_NAMES = ("method", "http_method", "request_method")
# --- end of fixed values ---


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    An expression used inside a lambda is otherwise computed again for every
    element the lambda visits.
    """
    return F.transform(F.array(value), body)[0]


def first_uri_column(columns: list[str]) -> str | None:
    for c in columns:
        if any(part in c.lower() for part in URI_NAME_PARTS):
            return c
    return None


def first_method_column(columns: list[str]) -> str | None:
    return next((c for c in columns if c.lower() in METHOD_NAMES), None)


def or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def uri_length(uri: Column) -> Column:
    return F.length(or_empty(uri)).cast("double")


def uri_slashes(uri: Column) -> Column:
    s = or_empty(uri)
    return (F.length(s) - F.length(F.replace(s, F.lit("/"), F.lit("")))).cast("double")


def uri_non_alnum_ratio(uri: Column) -> Column:
    s = or_empty(uri)
    alnum = F.length(F.regexp_replace(s, "[^a-zA-Z0-9]", ""))
    return (F.length(s) - alnum) / F.greatest(F.length(s), F.lit(1)).cast("double")


def md5_bucket(text: Column, buckets: int) -> Column:
    """Stable bucket of a string from the first 32 bits of its MD5."""
    return (
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % buckets
    ).cast("double")


def method_bucket(method: Column) -> Column:
    return md5_bucket(or_empty(method), METHOD_BUCKETS)


def fingerprint_bucket(parts: list[Column]) -> Column:
    if not parts:
        return F.lit(0.0)
    joined = F.concat_ws("|", *[or_empty(p) for p in parts])
    return md5_bucket(joined, FINGERPRINT_BUCKETS)


def _dns_labels(name: Column) -> tuple[Column, Column]:
    body = F.regexp_replace(F.trim(or_empty(name)), r"\.+$", "")
    return body, F.filter(F.split(body, r"\."), lambda p: p != "")


def dns_length(name: Column) -> Column:
    return F.length(or_empty(name)).cast("double")


def dns_label_count(name: Column) -> Column:
    return F.size(_dns_labels(name)[1]).cast("double")


def dns_longest_label(name: Column) -> Column:
    labels = _dns_labels(name)[1]
    longest = F.array_max(F.transform(labels, lambda p: F.length(p)))
    return F.coalesce(longest, F.lit(0)).cast("double")


def dns_digit_ratio(name: Column) -> Column:
    body = _dns_labels(name)[0]
    digits = F.length(F.regexp_replace(body, "[^0-9]", ""))
    return digits / F.greatest(F.length(body), F.lit(1)).cast("double")


def entropy(text: Column) -> Column:
    """Shannon entropy over the characters of a string, in bits."""

    def of(s: Column) -> Column:
        total = F.length(s).cast("double")

        def step(acc: Column, ch: Column) -> Column:
            p = (F.length(s) - F.length(F.replace(s, ch, F.lit("")))) / total
            return acc - p * F.log2(p)

        summed = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), step)
        return F.when(s == "", F.lit(0.0)).otherwise(summed + F.lit(0.0))

    return let(or_empty(text), of)


def byte_entropy(data: Column) -> Column:
    """Entropy over bytes with the 1e-12 smoothing inside the logarithm."""

    def of(pairs: Column) -> Column:
        total = F.size(pairs).cast("double")

        def step(acc: Column, pair: Column) -> Column:
            p = F.size(F.filter(pairs, lambda x: x == pair)) / total
            return acc - p * F.log2(p + F.lit(1e-12))

        summed = F.aggregate(F.array_distinct(pairs), F.lit(0.0), step)
        return F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, F.lit(0.0)).otherwise(
            summed + F.lit(0.0)
        )

    return let(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), of)


def http_line(payload: Column) -> Column:
    """First line of a request or response (at most 512 characters), else null.

    512 is the published definition of the line, not a sampling limit.
    """
    line = F.substring(
        F.substring_index(F.decode(payload, "ISO-8859-1"), "\r\n", 1), 1, HTTP_LINE_BYTES
    )
    starts = F.lit(False)
    for s in HTTP_LINE_STARTS:
        starts = starts | line.startswith(s)
    return F.when(starts, line)


def is_suspicious_uri(uri: Column) -> Column:
    lowered = F.lower(or_empty(uri))
    found = F.lit(False)
    for part in SUSPICIOUS_URI_PARTS:
        found = found | lowered.contains(part)
    return found


def row_fingerprint(columns: list[Column]) -> Column:
    """SHA-256 of the row's values joined by ``|``; null prints as ``nan``."""
    parts = [F.coalesce(c.cast("string"), F.lit("nan")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def alert_hash(columns: list[str]) -> Column:
    """SHA-1 of the alert as JSON with its fields in alphabetical order."""
    fields = [F.col(f"`{c}`").alias(c) for c in sorted(columns)]
    return F.sha1(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def incident_id(alert_hash_col: Column) -> Column:
    return F.concat(F.lit("inc_"), F.substring(alert_hash_col, 1, 12))


STRICT_JSON = {"allowSingleQuotes": "false"}


def json_kind(line: Column) -> Column:
    """``object``, ``other`` or null (not JSON) for a line of text.

    Spark's parsers stop after the first value and let anything follow it. Put
    inside an array and inside an object, a line parses in both only when it
    is exactly one value.
    """

    def of(text: Column) -> Column:
        in_array = F.from_json(
            F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT_JSON
        )
        in_object = F.from_json(
            F.concat(F.lit('{"w":'), text, F.lit("}")), "struct<w:string>", STRICT_JSON
        )["w"]
        valid = in_array.isNotNull() & (in_object.isNotNull() | (text == "null"))
        kind = F.when(text.startswith("{"), F.lit("object")).otherwise(F.lit("other"))
        return F.when((text != "") & valid, kind)

    return let(F.trim(line), of)


def json_field(line: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON line, null on bad JSON or an absent path."""
    text = F.trim(line)
    value = F.try_variant_get(F.try_parse_json(text), f"$.{path}", kind)
    return F.when(json_kind(text).isNotNull(), value)
