"""Typing, cleaning and label expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_DATE_START = r"^\s*\d{4}[-/]\d{2}[-/]\d{2}"
DAY_FIRST_FORMATS = (
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "d/M/yyyy h:mm:ss a",
    "d/M/yyyy",
    "d-M-yyyy H:mm:ss",
)
BLANK_TOKENS = ("", "nan", "nat", "none")


def clean_header(names: list[str]) -> list[str]:
    """Header names without blanks and BOM, duplicates numbered, ``Label`` named.

    A repeated name gets ``.1``, ``.2`` … in order of appearance, which is how
    the public data set's second ``Fwd Header Length`` is known downstream.
    """
    stripped = [n.strip().lstrip("\ufeff").strip() for n in names]
    seen: dict[str, int] = {}
    unique = []
    for name in stripped:
        n = seen.get(name, 0)
        seen[name] = n + 1
        unique.append(name if n == 0 else f"{name}.{n}")
    if "Label" not in unique:
        lowered = [n.lower() for n in unique]
        for alias in ("label", "labels"):
            if alias in lowered:
                # the last column wins when several spell the alias alike
                at = len(lowered) - 1 - lowered[::-1].index(alias)
                unique[at] = "Label"
                break
    return unique


def name(column: str) -> Column:
    """A column by its literal name, dots and slashes included."""
    return F.col(f"`{column}`")


def parse_double(text: Column) -> Column:
    """Text to double, null when it is not a plain number.

    Java accepts a type suffix (``1d``, ``2f``); such text is not a number here.
    """
    trimmed = F.lower(F.trim(text.cast("string")))
    suffixed = F.right(trimmed, F.lit(1)).isin("d", "f") & ~trimmed.isin(
        "inf", "+inf", "-inf"
    )
    return F.when(~suffixed, trimmed.try_cast("double"))


def number_or_zero(value: Column, is_text: bool = True) -> Column:
    """Coerced number; unparsable, missing and NaN become 0."""
    parsed = parse_double(value) if is_text else value.cast("double")
    return F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0))


def parse_timestamp(text: Column) -> Column:
    """Two-family timestamp: ISO when it starts with a year, else day first."""
    trimmed = F.trim(text)
    usable = text.isNotNull() & ~F.lower(trimmed).isin(*BLANK_TOKENS)
    dashed = F.concat(
        F.translate(F.substring(trimmed, 1, 10), "/", "-"), F.substr(trimmed, F.lit(11))
    )
    iso = F.try_to_timestamp(dashed)
    day_first = F.coalesce(
        *[F.try_to_timestamp(trimmed, F.lit(f)) for f in DAY_FIRST_FORMATS]
    )
    return F.when(
        usable, F.when(text.rlike(ISO_DATE_START), iso).otherwise(day_first)
    )


def to_utc(ts: Column, zone: str | None = None) -> Column:
    """Instant in UTC; a wall-clock value is read in ``zone`` when one is given."""
    stamp = ts.cast("timestamp")
    return F.to_utc_timestamp(stamp, zone) if zone else stamp


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def is_attack(label: Column) -> Column:
    """1 unless the label reads BENIGN in any case (blanks count as content)."""
    return (F.upper(F.coalesce(label.cast("string"), F.lit("nan"))) != "BENIGN").cast("int")


def attack_class(is_attack_col: Column | None, label: Column | None = None) -> Column:
    """Binary class name from the 0/1 column, or from the trimmed label."""
    if is_attack_col is not None:
        attack = F.coalesce(is_attack_col.cast("int"), F.lit(0)) == 1
    else:
        attack = F.upper(F.trim(label)) != "BENIGN"
    return F.when(attack, F.lit("ATTACK")).otherwise(F.lit("BENIGN"))


def bucket_micros(ts: Column, seconds: int) -> Column:
    """Start of the epoch-anchored time bucket, in microseconds."""
    step = seconds * 1_000_000
    m = micros(ts)
    return m - F.pmod(m, F.lit(step).cast("long"))
