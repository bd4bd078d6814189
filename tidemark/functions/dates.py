"""Calendar arithmetic on whole columns."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import DAILY, MONTHLY, QUARTERLY, WEEKLY

_TRUNC = {WEEKLY: "week", MONTHLY: "month", QUARTERLY: "quarter"}
_STEP = {
    DAILY: "interval 1 day",
    WEEKLY: "interval 7 days",
    MONTHLY: "interval 1 month",
    QUARTERLY: "interval 3 months",
}


def checked(frequency: str) -> str:
    if frequency not in _STEP:
        raise ValueError(f"Unknown frequency {frequency!r}; use one of {', '.join(_STEP)}.")
    return frequency


def period_start(day: Column, frequency: str) -> Column:
    """First day of the period a date falls in (weeks open on Monday)."""
    checked(frequency)
    return day if frequency == DAILY else F.trunc(day, _TRUNC[frequency])


def add_periods(day: Column, count: Column | int, frequency: str) -> Column:
    """Move a date by whole periods, clamping to the end of shorter months."""
    checked(frequency)
    steps = F.lit(count) if isinstance(count, int) else count
    steps = steps.cast("int")
    if frequency == DAILY:
        return F.date_add(day, steps)
    if frequency == WEEKLY:
        return F.date_add(day, steps * 7)
    return F.add_months(day, steps * 3 if frequency == QUARTERLY else steps)


def period_end(day: Column, frequency: str) -> Column:
    return F.date_sub(add_periods(period_start(day, frequency), 1, frequency), 1)


def period_index(day: Column, frequency: str) -> Column:
    """An integer that grows by one per period, for distances on the calendar."""
    checked(frequency)
    if frequency == DAILY:
        return F.unix_date(day)
    if frequency == WEEKLY:
        # 1970-01-05 was a Monday.
        return F.floor((F.unix_date(F.trunc(day, "week")) - 4) / 7).cast("int")
    if frequency == MONTHLY:
        return (F.year(day) * 12 + F.month(day) - 1).cast("int")
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("int")


def periods_between(first: Column, last: Column, frequency: str) -> Column:
    """Array of the periods from first to last, both included."""
    return F.sequence(first, last, F.expr(_STEP[checked(frequency)]))


def is_settled(period: Column, reach: Column, frequency: str) -> Column:
    """Whether a period can still grow: over, or a later one already has data."""
    return (period_end(period, frequency) <= reach) | (
        period_start(period, frequency) < period_start(reach, frequency)
    )


def as_date(frame: DataFrame, name: str) -> Column:
    """Read a column as a date; what cannot be read is null, never an error."""
    kind = frame.schema[name].dataType
    column = frame[name]
    if isinstance(kind, T.DateType):
        return column
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return column.cast("date")
    return column.cast("string").try_cast("date")


def as_double(frame: DataFrame, name: str) -> Column:
    kind = frame.schema[name].dataType
    column = frame[name]
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    return column.cast("string").try_cast("double")


def _day(value: date | str) -> date:
    if isinstance(value, datetime):
        return value.date()
    return date.fromisoformat(value) if isinstance(value, str) else value


def within(frame: DataFrame, name: str, start: date | str | None, end: date | str | None) -> DataFrame:
    """Keep raw dates from start to end, both included.

    The bounds are put on the stored column itself, not on a cast of it, so a
    typed date or timestamp column carries them down to the file scan.
    """
    kind = frame.schema[name].dataType
    raw = frame[name]
    stamped = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    plain = isinstance(kind, T.DateType)
    column = raw if stamped or plain else as_date(frame, name)

    def midnight(day: date) -> Column:
        return F.lit(datetime(day.year, day.month, day.day)).cast(kind)

    if start is not None:
        first = _day(start)
        frame = frame.filter(column >= (midnight(first) if stamped else F.lit(first)))
    if end is not None:
        last = _day(end)
        if stamped:
            frame = frame.filter(column < midnight(last + timedelta(days=1)))
        else:
            frame = frame.filter(column <= F.lit(last))
    return frame
