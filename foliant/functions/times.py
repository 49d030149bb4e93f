"""Timestamps as numbers, whatever the session's time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, reading the clock time as UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)
