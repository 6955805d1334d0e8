"""Timestamps as whole epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_epoch(text: Column) -> Column:
    """Seconds of an RFC 3339 text, 0 where it does not parse."""
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(text)), F.lit(0))


def strict_epoch(text: Column) -> Column:
    return F.unix_seconds(F.to_timestamp(text))


def iso(seconds: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ; computed on the days and seconds of day, so in UTC whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    s = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60), F.lit("Z"))
