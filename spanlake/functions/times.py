"""Time ranges, buckets and clock arithmetic."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F


def instant(value) -> Column:
    """A timestamp from a Column, a datetime (naive means UTC), epoch ms or ISO text."""
    if isinstance(value, Column):
        return value
    if isinstance(value, int):
        value = datetime.fromtimestamp(value / 1000, tz=timezone.utc)
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.lit(value)


def in_range(df: DataFrame, ts: str, start=None, end=None, closed: bool = False) -> DataFrame:
    """Rows with ``start <= ts < end`` (``<= end`` when closed); either bound may be absent.

    The bounds stay on the raw column, so they reach the Parquet scan; tables stored by
    day get the matching ``date`` predicate too, which prunes folders.
    """
    by_day = "date" in df.columns
    if start is not None:
        low = instant(start)
        df = df.where(F.col(ts) >= low)
        df = df.where(F.col("date") >= F.to_date(low)) if by_day else df
    if end is not None:
        high = instant(end)
        df = df.where(F.col(ts) <= high if closed else F.col(ts) < high)
        df = df.where(F.col("date") <= F.to_date(high)) if by_day else df
    return df


def bucket_ms(ts: Column, step_seconds: int) -> Column:
    """Start of the ``step_seconds`` bucket holding ``ts``, in epoch milliseconds."""
    step = max(int(step_seconds), 1) * 1000
    return F.floor(F.unix_millis(ts) / F.lit(step)) * F.lit(step)


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def width_seconds(width: str) -> int:
    """Seconds in a width such as ``"1 minute"`` or ``"2 hours"``."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", width)
    if not found or int(found.group(1)) < 1:
        raise ValueError(f"not a bucket width: {width!r}")
    return int(found.group(1)) * _UNITS[found.group(2)]


def bucket_start(ts: Column, width: str = "1 minute") -> Column:
    """Start of the tumbling bucket holding ``ts``, as a timestamp."""
    if width_seconds(width) == 60:
        return F.date_trunc("minute", ts)
    return F.timestamp_millis(bucket_ms(ts, width_seconds(width)))


def seconds_before(as_of, seconds: int) -> Column:
    return instant(as_of) - F.make_dt_interval(secs=F.lit(int(seconds)))


#: Minutes looked back where the caller names no range: patterns an hour, findings half of it.
DEFAULT_MINUTES = {"patterns": 60, "findings": 30}


def recent(as_of, minutes: int) -> tuple[Column, Column]:
    """(start, end) of the last ``minutes`` before ``as_of``."""
    return seconds_before(as_of, minutes * 60), instant(as_of)


def auto_step(start_ms: int, end_ms: int) -> int:
    """Step in whole seconds that gives about 120 points, 15 s at the least."""
    return max(15, round((end_ms - start_ms) / 120 / 1000))
