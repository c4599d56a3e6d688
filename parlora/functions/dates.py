"""Column functions over time stamps kept as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_time(value: Column) -> Column:
    """UTC ISO 8601 with ``Z`` for an epoch number, a numeric string or an ISO time as text; null for null or blank.

    A time without a zone is UTC. Microseconds show only where they aren't zero. Anything else fails the query.
    """
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    numeric = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    epoch = F.timestamp_micros(F.bround(text.cast("double") * 1_000_000).cast("long"))
    zoned = F.when(text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") | ~text.contains(":"), text).otherwise(F.concat(text, F.lit("Z")))
    moment = F.when(numeric, epoch).otherwise(F.to_timestamp(zoned))
    shown = F.regexp_replace(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.000000Z$", "Z")
    return F.when(text.isNotNull(), shown)


def date_prefix(stamp: Column) -> Column:
    """The ``YYYY-MM-DD`` a stamp begins with, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(stamp, F.lit("")), r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))


def day_number(date: Column) -> Column:
    """365 days a year and 30 a month: rough on purpose, no calendar."""
    part = lambda a, n: F.substring(date, a, n).cast("int")
    return part(1, 4) * 365 + part(6, 2) * 30 + part(9, 2)


def days_between(a: Column, b: Column) -> Column:
    """The rough distance of two dates in days; 999 where either can't be read."""
    readable = r"^\d{4}.\d{2}.\d{2}"
    return F.when(a.rlike(readable) & b.rlike(readable), F.abs(day_number(b) - day_number(a))).otherwise(F.lit(999))


def bound(value: str, end: bool) -> str:
    """An inclusive bound of a date filter; a plain date covers its whole day."""
    return value + ("T23:59:59.999999Z" if end else "T00:00:00Z") if len(value) == 10 else value
