"""Access-log functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dotted-quad octet without leading zeros, and the log date format.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
LOG_DATE_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"


def valid_ipv4(ip: Column) -> Column:
    """Strict dotted quad."""
    return ip.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}\z")


def ip_number(ip: Column) -> Column:
    """Dotted quad as a number; the address must be valid."""
    octets = F.split(ip, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.get(octets, F.lit(i)).try_cast("long")
    return value


def log_minute(date: Column) -> Column:
    """Log date truncated to its minute, as a timestamp; the offset is honoured."""
    return F.date_trunc("minute", F.try_to_timestamp(date, F.lit(LOG_DATE_FORMAT)))


def log_bytes(size: Column) -> Column:
    """Byte count; ``-`` and anything that is no number count as 0."""
    return F.coalesce(size.try_cast("long"), F.lit(0).cast("long"))


def null_literal(col: Column) -> Column:
    """The text ``null`` in place of a missing name."""
    return F.coalesce(col, F.lit("null"))
