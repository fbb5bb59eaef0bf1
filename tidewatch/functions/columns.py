"""Column helpers for parsing numbers, timestamps and IPv4 addresses without Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(c: Column | str) -> Column:
    """A number or a numeric string as long, truncated; anything else is null."""
    return F.col(c).try_cast("double").try_cast("long") if isinstance(c, str) else c.try_cast("double").try_cast("long")


def number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def timestamp(c: Column) -> Column:
    """Epoch seconds (number as text) or an ISO time with offset or Z; else null."""
    return F.coalesce(F.timestamp_seconds(c.try_cast("double")), F.try_to_timestamp(c))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def ipv4(address: Column) -> Column:
    """The address as a number, null for anything but four octets."""
    parts = F.split(address, r"\.")
    octet = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("long")
    value = sum((octet(i) * 256 ** (3 - i) for i in range(1, 4)), octet(0) * 256**3)
    return F.when(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), value)


def cidr_range(cidr: str) -> tuple[int, int]:
    """First and last address of a block as numbers; a plain address is a block of one."""
    address, _, bits = cidr.partition("/")
    value = sum(int(x) << 8 * (3 - i) for i, x in enumerate(address.split(".")))
    size = 1 << (32 - int(bits or 32))
    return value // size * size, value // size * size + size - 1


def at_least(c: Column, floor: float) -> Column:
    """The larger of the two; null stays null (``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))
