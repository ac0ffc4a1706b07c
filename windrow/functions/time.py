"""Durations and epoch arithmetic."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds(duration: str) -> int:
    """``"5 minutes"`` -> 300. Months and years have no fixed length and are refused."""
    amount, unit = duration.split()
    try:
        return int(amount) * _UNIT_SECONDS[unit.lower().rstrip("s")]
    except KeyError:
        raise ValueError(f"not a fixed-length duration: {duration!r}") from None


def whole_multiple(width: str, step: str) -> int:
    """How many steps make up ``width``; the windows built here need a whole number."""
    count, rest = divmod(seconds(width), seconds(step))
    if rest or not count:
        raise ValueError(f"{width!r} is not a whole multiple of {step!r}")
    return count


def epoch(column: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_seconds(column.cast("timestamp"))


def shift(column: str | Column, by_seconds: int) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column + F.expr(f"INTERVAL '{by_seconds}' SECOND")


def bound(moment: datetime | str) -> Column:
    """A moment as a literal that reads the same whatever the driver's time zone: naive ones are in UTC."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, datetime):
        if moment.tzinfo is not None:
            moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
        moment = moment.isoformat(sep=" ")
    return F.lit(moment).cast("timestamp_ntz")
