"""Log search and live tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.attrs import attrs_map
from ..functions.codes import severity_floor
from ..functions.text import match_tokens
from ..functions.times import in_range, instant, seconds_before, width_seconds
from ..functions.topk import first_by_time

DEFAULT_LIMIT = 1000
TAIL_LIMIT = 100


def severity_min_filter(logs: DataFrame, severity: str | None) -> DataFrame:
    """Rows at or above a named level; an unknown or absent name filters nothing."""
    floor = severity_floor(severity)
    return logs if floor is None else logs.where(F.col("severity_number") >= floor)


def trace_filter(logs: DataFrame, trace_id: str) -> DataFrame:
    return logs.where(F.col("trace_id") == trace_id)


def regex_filter(logs: DataFrame, pattern: str) -> DataFrame:
    return logs.where(F.col("body").rlike(pattern))


def filter_logs(logs: DataFrame, start=None, end=None, service: str | None = None,
                severity: str | None = None, query: str | None = None,
                trace_id: str | None = None) -> DataFrame:
    """Logs that pass every given filter."""
    rows = in_range(logs, "timestamp", start, end)
    if service is not None:
        rows = rows.where(F.col("service") == service)
    rows = severity_min_filter(rows, severity)
    if trace_id is not None:
        rows = trace_filter(rows, trace_id)
    if query:
        rows = rows.where(match_tokens(F.col("body"), query))
    return rows


def log_entries(logs: DataFrame) -> DataFrame:
    """Entries: id ``trace:span:ms``, ts in ms, attributes as a map."""
    ts = F.unix_millis("timestamp")
    return logs.select(
        F.concat_ws(":", "trace_id", "span_id", ts.cast("string")).alias("id"), ts.alias("ts"),
        "service", F.col("severity_text").alias("severity"), "body", "trace_id", "span_id",
        attrs_map().alias("attrs"))


def _newest(logs: DataFrame, limit: int) -> DataFrame:
    return log_entries(first_by_time(logs, "timestamp", limit, ["trace_id", "span_id"],
                                     newest=True))


def logs_search(logs: DataFrame, start=None, end=None, service: str | None = None,
                severity: str | None = None, query: str | None = None,
                trace_id: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest ``limit`` entries that pass the filters, newest first."""
    return _newest(filter_logs(logs, start, end, service, severity, query, trace_id), limit)


def live_tail(logs: DataFrame, as_of, lookback: str = "10 minutes", limit: int = TAIL_LIMIT,
              service: str | None = None, severity: str | None = None,
              query: str | None = None) -> DataFrame:
    """Newest entries of the look-back period that ends at ``as_of``."""
    start = seconds_before(as_of, width_seconds(lookback))
    return logs_search(logs, start, instant(as_of), service, severity, query, limit=limit)
