"""Time helpers that give the same answer in every session time zone: zone-less timestamps are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_of(ts: Column, unit: str = "SECOND") -> Column:
    """Whole units since 1970 of a zone-less timestamp."""
    return F.timestamp_diff(unit, _epoch(), ts)


def instant_of(ts: Column) -> Column:
    """Zone-less timestamp to an instant, as watermarks need."""
    return F.timestamp_micros(epoch_of(ts, "MICROSECOND"))


def wall_of(ts: Column) -> Column:
    """Instant to a zone-less UTC timestamp."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), _epoch())


def iso_time(epoch_seconds: Column) -> Column:
    """UTC text of epoch seconds."""
    return F.date_format(F.timestamp_add("SECOND", epoch_seconds, _epoch()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
