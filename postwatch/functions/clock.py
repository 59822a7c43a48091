"""Time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time formats of the records and of the window borders.
CREATED_AT = "EEE MMM dd HH:mm:ss Z yyyy"
BORDER = "yyyy-MM-dd HH:mm:ss Z"

# Windows are six hours long; a day starts at -04:00, which is 04:00 UTC.
WINDOW = "6 hours"
DAY_START = "4 hours"


def format_created_at(ts: Column) -> Column:
    return F.date_format(ts, CREATED_AT)


def parse_created_at(text: Column) -> Column:
    """The record's time as a timestamp, null when it does not parse.

    Week days cannot be parsed by pattern, so the text is read from the month on.
    """
    return F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit(CREATED_AT[4:]))


def border(text: str) -> Column:
    """A window border such as ``2018-10-16 00:00:00 -0400``."""
    return F.to_timestamp(F.lit(text), BORDER)


def between(ts: Column, start: Column, end: Column) -> Column:
    """Start included, end excluded.  On a stored timestamp this reaches the file scan."""
    return (ts >= start) & (ts < end)


def window_end(ts: Column, day_start: str | None = None) -> Column:
    """End of the six-hour window that holds ``ts``; windows are stamped with their end."""
    return F.window(ts, WINDOW, startTime=day_start)["end"]
